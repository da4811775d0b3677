"""Ordered append, faults over blocks, snapshots."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from factlog.operators import state
from factlog.operators.snapshots import Snapshots
from factlog.sources import log

GROUPS = "grp string, tx string, e string, a string, op string, v string, checksum string"


def groups(spark, rows):
    """(grp, tx, sealed)"""
    return spark.createDataFrame([(g, t, f"entry:{i % 50}", "a", "add", str(i), "x" if sealed else None) for i, (g, t, sealed) in enumerate(rows)], GROUPS)


def plain_check(rows, last):
    out, seen = {}, {}
    for g, t, sealed in rows:
        seen.setdefault(g, []).append((t, sealed))
    for g in sorted(seen):
        txs = {t for t, _ in seen[g]}
        if len(txs) > 1:
            out[g] = "MIXED_TX"
        elif not all(s for _, s in seen[g]):
            out[g] = "UNSEALED"
        elif last is not None and min(txs) <= last:
            out[g] = "TX_NOT_GREATER"
        else:
            out[g], last = None, min(txs)
    return out, last


@pytest.mark.parametrize("ranges", [1, 7])
def test_groups_are_refused_as_one_by_one(spark, ranges):
    rng = random.Random(4)
    rows = []
    for g in range(200):
        tx = f"{g + rng.choice([0, 0, 0, 5, -5]):06d}"
        rows += [(f"g{g:04d}", tx if rng.random() < 0.97 else "0", rng.random() < 0.97) for _ in range(rng.randint(1, 3))]
    for last in (None, "000050"):
        got = {r.grp: r.error for r in log.check_group(groups(spark, rows).repartition(5), last, ranges).collect()}
        assert got == plain_check(rows, last)[0] and set(got.values()) >= {None, "MIXED_TX", "UNSEALED", "TX_NOT_GREATER"}
    assert log.check_group(groups(spark, rows[:0]), None).count() == 0


def test_append_is_ordered_repeatable_and_whole(spark, tmp_path):
    table = log.FactTable(spark, str(tmp_path / "log"), rows_per_file=100)
    with pytest.raises(FileNotFoundError):
        table.read()
    one = groups(spark, [(f"g{i:04d}", f"{i:026d}", True) for i in range(1000)])
    table.append(one, 0)
    table.append(one, 0)  # the same batch again
    assert table.read().count() == 1000 and table.last_tx() == f"{999:026d}"
    days = {r.tx_day for r in table.read().select("tx_day").distinct().collect()}
    assert len(days) == 1 and len(glob.glob(str(tmp_path / "log/data/*/tx_day=*/part-*"))) >= 4  # one day, several tasks
    report = {r.error: r.n for r in table.append(groups(spark, [("h0", f"{500:026d}", True), ("h1", f"{2000:026d}", True), ("h2", f"{1500:026d}", True)]), 1).groupBy("error").agg(F.count("*").alias("n")).collect()}
    assert report == {None: 1, "TX_NOT_GREATER": 2} and table.read().count() == 1001 and table.last_tx() == f"{2000:026d}"

    def fail(version):
        raise OSError

    publish, table.versions.publish = table.versions.publish, fail
    with pytest.raises(OSError):
        table.append(groups(spark, [("i", f"{3000:026d}", True)]), 2)
    assert table.read().count() == 1001 and table.last_tx() == f"{2000:026d}"
    table.versions.publish = publish
    table.append(groups(spark, [("i", f"{3000:026d}", True)]), 2)
    assert table.read().count() == 1002
    table.append(groups(spark, [("j", f"{3000:026d}", True)]), 3)  # all refused: an empty batch is a batch
    assert table.read().count() == 1002 and table.versions.numbers() == [0, 1, 2, 3]


@pytest.mark.parametrize("block", [3, 100_000])
def test_faults_do_not_depend_on_the_blocks(spark, block):
    facts = [(f"{t:05d}", "2024-01-01T00:00:00Z", "me", "add", "entry:1", "a", str(t), "observe", "i") for t in [1, 2, 3, 4, 5, 6, 6, 7, 8, 2]]
    f = spark.createDataFrame(facts, "tx string, ts string, actor string, op string, e string, a string, v string, src string, invocation_id string")
    lines = sorted(((r.v, r.line) for r in log.to_lines(f).select("v", "line").collect()), key=lambda x: int(x[0]))
    by = {t: x for t, x in lines}
    order = lambda ts: [by[str(t)] for t in ts]
    files = {"good": order([1, 2, 3, 4, 5, 6, 6, 7, 8]), "late": order([1, 2, 3, 4, 5, 6, 2, 7]), "first_of_block": order([1, 2, 5, 3, 6, 7]), "json": [*order([1, 2, 3]), "{", *order([2])], "sum": [*order([1, 2, 3]), by["4"].replace('"a"', '"b"')]}
    rows = [(n, i, x, True) for n, xs in files.items() for i, x in enumerate(xs)] + [("open", i, by[str(i + 1)], False) for i in range(4)]
    got = {r.file: (r.line_no, r.fault) for r in log.faults(spark.createDataFrame(rows, "file string, line_no int, line string, ended boolean").repartition(4), block).collect()}
    assert got == {"late": (6, "TX_ORDER"), "first_of_block": (3, "TX_ORDER"), "json": (3, "BAD_JSON"), "sum": (3, "BAD_CHECKSUM"), "open": (3, "NO_NEWLINE")}


def test_snapshots_give_every_state_from_few_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"{i:05d}", f"entry:{rng.randint(0, 20)}", f"a{rng.randint(0, 5)}", "retract" if rng.random() < 0.2 else "add", str(i)) for i in range(1, 1001) for _ in range(rng.randint(1, 2))]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())  # a transaction writes an attribute once
    f = spark.createDataFrame(rows, "tx string, e string, a string, op string, v string").repartition(3).cache()
    kept = Snapshots(spark, str(tmp_path / "s"), every=100)
    for upto in (40, 333, 350, 1000):
        kept.extend(f.where(F.col("tx") <= f"{upto:05d}"))
    assert kept.extend(f).number == kept.versions.numbers()[-1]  # nothing new, no new version
    now = kept.versions.current()
    assert sorted(b for t, b in now.places if t == "state") == list(range(10))
    key = lambda df: sorted(map(tuple, df.select("e", "a", "v", "tx").collect()))

    def check(most, times):
        for tx in [f"{t:05d}" for t in times]:
            read = kept.as_of(tx)
            assert key(read) == key(state.latest(state.as_of(f, tx))), tx
            folders = {p.split("/data/")[1].split("/")[0] for p in read.inputFiles()}
            assert len(folders) <= most  # a state and a segment, whatever the log's length

    check(2, (0, 1, 99, 100, 101, 333, 350, 400, 901, 1000, 2000))
    kept.compact(keep=2)
    assert len([1 for t, _ in kept.versions.current().places if t == "state"]) == 6
    kept.versions.vacuum(1)
    check(3, (50, 100, 250, 334, 555, 600, 777, 800, 999))
