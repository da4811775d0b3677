"""Versions, buckets and the commit protocol of the derived tables; activation as keyed state of a stream."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from factlog.functions import hooks
from factlog.operators import activation, state
from factlog.operators.projection import Projection, Rejected
from factlog.streaming import streams

FACTS = "tx string, op string, e string, a string, v string"


def facts(spark, rows):
    return spark.createDataFrame([(f"{tx:026d}", *rest) for tx, *rest in rows], FACTS)


def log(n=400):
    rows = [(i, "retract" if i % 17 == 0 else "add", f"entry:{i % 40}", ["body", "kind", "in_trail", "derived_from"][i % 4], f'"x{i % 7}"') for i in range(n)]
    return rows + [(n + i, "add", f"entry:{i}", "link.SIMILAR_TO", '{"target":"entry:%d","confidence":0.%d}' % (i + 1, i + 1)) for i in range(5)]


def rows(df):
    return sorted(map(repr, df.collect()))


def same(p, f):
    assert rows(p.latest()) == rows(state.latest(f).select("e", "a", "v", "tx"))
    assert rows(p.edges()) == rows(state.edges(f))


def test_ten_batches_equal_the_whole_log(spark, tmp_path):
    log_ = log()
    p = Projection(spark, str(tmp_path / "p"), buckets=8)
    for k in range(10):  # late facts too: a batch takes every tenth row
        p.apply(facts(spark, log_[k::10]), k)
        assert p.apply(facts(spark, log_[k::10]), k) is None  # a batch that is there is not made again
    same(p, facts(spark, log_))
    assert p.watermark() == f"{log_[-1][0]:026d}" and p.versions.numbers() == list(range(10))
    assert p.versions.vacuum(2) > 0 and p.versions.numbers() == [8, 9]
    same(p, facts(spark, log_))


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    p = Projection(spark, str(tmp_path / "p"), buckets=16)
    old = p.apply(facts(spark, log()))
    new = p.apply(facts(spark, [(9000, "add", "entry:3", "kind", '"y"'), (9001, "add", "entry:3", "body", '"z"')]))
    changed = {k for k in new.places if new.places[k] != old.places.get(k)}
    assert len([k for k in changed if k[0] == "state"]) == 1 and not [k for k in changed if k[0] == "edges"]
    written = {os.path.dirname(new.places[k]) for k in changed}
    assert sum(f.startswith("part-") for w in written for _, _, fs in os.walk(w) for f in fs) == len(changed)


@pytest.mark.parametrize(("step", "at"), [("heal", "write"), ("heal", "check"), ("heal", "publish"), ("rebuild", "publish")])
def test_a_failure_leaves_tables_and_watermark(spark, tmp_path, step, at):
    first, whole = facts(spark, log(100)), facts(spark, log(100) + [(2000 + i, "add", f"entry:{i}", "body", '"new"') for i in range(60)])
    path = str(tmp_path / "p")
    Projection(spark, path, 4).heal(first)

    def fail(now):
        if now == at:
            raise OSError(at)

    broken = Projection(spark, path, 4, before=fail)
    with pytest.raises(OSError, match=at):
        getattr(broken, step)(whole)
    p = Projection(spark, path, 4)
    same(p, first)
    assert p.watermark() == f"{104:026d}"
    done = getattr(p, step)(whole)
    same(p, whole)
    assert p.watermark() == f"{2059:026d}" and done.values["scanned"] == ("60" if step == "heal" else "165")
    assert p.heal(whole) is None  # nothing is left to apply
    assert p.versions.vacuum(1) > 0
    same(p, whole)


def test_a_rebuild_is_checked_and_repeats_itself(spark, tmp_path):
    f = facts(spark, log(60) + [(500, "add", "entry:1", "embedding_model_digest", "old"), (501, "add", "entry:2", "embedding_model_digest", "new")])
    embed = lambda df: hooks.embed(df, dim=8).withColumn("digest", F.lit("new"))
    p = Projection(spark, str(tmp_path / "p"), 4)
    with pytest.raises(Rejected):
        p.rebuild(f, embed, "new", accept_drift=False)
    assert p.versions.current() is None
    one = p.rebuild(f, embed, "new")
    first = [rows(p.table(t)) for t in ("state", "edges", "vectors")]
    two = p.rebuild(f, embed, "new")
    assert [rows(p.table(t)) for t in ("state", "edges", "vectors")] == first and one.values == two.values and one.values["rebinds"] == "1"
    assert p.table("vectors").count() == state.latest(f.where("a = 'body'")).count() > 0


def test_a_stream_of_any_cut_gives_the_activation_of_the_log(spark, tmp_path):
    t = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    log_ = []
    for i in range(300):
        a = ["encoding_at", "base_activation", "retrieval_count", "last_retrieved_at", "evicted_at", "evicted_at_retracted", "pinned", "pin_activation", "other"][i % 9]
        v = {"base_activation": str(i % 5 / 4), "retrieval_count": str(i), "pinned": "true" if i % 2 else "false", "pin_activation": "0.5"}.get(a, f'"{t(i)}"')
        log_.append((i, "retract" if i % 50 == 0 else "add", f"entry:{i % 13}", a, v))
    path, shuffled = str(tmp_path / "in"), log_[::2] + log_[1::2]
    want = rows(activation.state(facts(spark, log_)))
    out = str(tmp_path / "out")

    def run(n):
        def keep(batch, k):
            batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/{k}")

        s = streams.activation_stream(streams.facts_stream(spark, path, FACTS, n))
        streams.run_activation(s, keep, str(tmp_path / "ck"))

    def last():
        r = spark.read.option("recursiveFileLookup", "true").parquet(out)
        return r.groupBy("e").agg(F.max_by(F.struct(*r.columns), "batch").alias("r")).select("r.*")

    for lo, hi in ((0, 90), (90, 180)):
        facts(spark, shuffled[lo:hi]).coalesce(1).write.mode("append").parquet(path)
    run(1)
    facts(spark, shuffled[180:]).coalesce(1).write.mode("append").parquet(path)
    run(1)  # a new query goes on from the checkpoint's state
    assert rows(streams.state_of(last())) == want
    due = {r.e: r.faded for r in last().collect()}
    now = F.current_timestamp()
    for r in activation.state(facts(spark, log_)).withColumn("now", activation.current(now)).collect():
        assert due[r.e] == (not r.evicted and not r.pinned and 0.0005 <= r.base_activation and r.now < 0.0005), r


def test_a_timer_reports_what_faded(spark, tmp_path):
    import time

    soon = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    path, out = str(tmp_path / "in"), []
    rows_ = lambda *r: facts(spark, r).coalesce(1).write.mode("append").parquet(path)

    def run():
        s = streams.activation_stream(streams.facts_stream(spark, path, FACTS, 1), threshold=0.3)
        streams.run_activation(s, lambda b, k: out.extend((r.e, r.faded) for r in b.collect()), str(tmp_path / "ck"))

    rows_((1, "add", "entry:1", "base_activation", "1"), (2, "add", "entry:1", "encoding_at", f'"{soon}"'))  # under 0.3 after 10 seconds
    run()
    assert out == [("entry:1", False)]
    time.sleep(9)
    rows_((3, "add", "entry:2", "base_activation", "0"))
    run()
    assert ("entry:1", True) in out and ("entry:2", False) in out
