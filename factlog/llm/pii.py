"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained from a small labelled table. Its sequences are windows of words around those that hold a digit or
an @ or spell an address out ("at", "dot"), so texts without any cost one scan. Decoding is Viterbi over numpy batches of
windows; long windows are cut into overlapping stretches and batches are filled by words, so memory does not grow with a text's runs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factlog.llm.common import small, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Tags: O, then B- and I- of every kind.
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SIDE = 2  # words on either side of one that holds a digit or an @
RUN, OVERLAP = 64, 8  # longer runs of words are decoded in stretches of RUN, each with OVERLAP more words on either side
CELLS = 16_384  # words, with padding, that are decoded at a time

# The patterns are the contract's; possessive repeats and the look-behind only spare them quadratic time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, start) if start < at else end
        at = text.find("@", max(at + 1, found.end() if found else 0))


def luhn(digits: str) -> bool:
    values = [int(x) for x in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * x, 10)) for x in values[1::2])) % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = _DIGITS.sub("", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`(kind, start, end)` by kind and start, in code points; failing matches are dropped without a retry."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return out


# --- the field ---

_SIGNAL = re.compile(r"[0-9@]|\b(?:dot|DOT|Dot)\b|\b(?:at|AT)\b(?=\S{0,1}\s+\S+\s+\S?(?:dot|DOT)\b)")
_WORD = re.compile(r"\S+")
_GAP = re.compile(r"\s")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end): every word with a digit or an @, or of a spelled-out address, and SIDE words on either side; touching
    runs are one."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := _SIGNAL.search(text, at):
        lo = m.start()
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        start = lo
        before = []
        floor = out[-1][-1][1] if out else 0
        for _ in range(SIDE):
            hi = start
            while hi > floor and text[hi - 1].isspace():
                hi -= 1
            first = hi
            while first > floor and not text[first - 1].isspace():
                first -= 1
            if first == hi:
                break
            before.append((first, hi))
            start = first
        word = _WORD.match(text, lo).span()
        run = [*before[::-1], word]
        joined = out and not text[floor : run[0][0]].strip()
        if joined:
            out[-1] += [w for w in run if w[0] >= floor]
        else:
            out.append(run)
        at = word[1]
        signals = _SIGNAL.search(text, at)
        after = []
        pos = at
        for _ in range(SIDE):
            w = _WORD.search(text, pos)
            if not w or (signals and w.end() > signals.start()):
                break
            after.append(w.span())
            pos = w.end()
        out[-1] += after
        at = pos
    return out


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs of over four of a kind cut to four; other signs as they are."""
    out = []
    for x in word[:80]:
        c = "9" if "0" <= x <= "9" else "a" if x.islower() else "A" if x.isalpha() else x
        if out[-4:] != [c] * 4:
            out.append(c)
    return "".join(out)


def word_features(word: str) -> list[str]:
    core = word.strip(".,;:!?\"'")
    digits = sum("0" <= x <= "9" for x in core)
    plain = core.lower() if core.isalpha() else ""
    return [
        f"s={shape(core)}", f"d={min(digits, 20)}", f"n={min(len(core), 20)}", f"p={core[:1] if not core[:1].isalnum() else ''}", f"dots={core.count('.')}", f"dash={core.count('-')}",
        f"at={'@' in core}", f"alpha={bool(plain)}", f"all={core.isdigit()}", f"w={plain}", f"hex={digits > 0 and any(x.isalpha() for x in core)}",
    ]


def sequence_features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    ends = ["edge"]
    out = []
    for i, mine in enumerate(own):
        left, right = own[i - 1] if i else ends, own[i + 1] if i + 1 < len(own) else ends
        out.append(mine + [f"-{x}" for x in left] + [f"+{x}" for x in right])
    return out


def allowed() -> np.ndarray:
    """0 where a tag may follow another (row START is last), -inf where an I- has no B- or I- of its kind before it."""
    out = np.zeros((len(TAGS) + 1, len(TAGS)))
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            for i, of in enumerate([*TAGS, "START"]):
                if of[2:] != to[2:] or of in ("O", "START"):
                    out[i, j] = -np.inf
    return out


class Field:
    """Weights of features by tag, and of transitions (the last row is the start)."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.w = np.zeros((len(index) + 1, len(TAGS)))  # the last row stays 0: unknown features
        self.t = np.zeros((len(TAGS) + 1, len(TAGS)))

    def scores(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (batch, longest, tags) and lengths."""
        sizes = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), sizes.max(), len(TAGS)))
        for i, s in enumerate(sequences):
            for j, names in enumerate(sequence_features(s)):
                out[i, j] = self.w[[self.index.get(x, -1) for x in names]].sum(axis=0)
        return out, sizes

    def decode(self, sequences: list[list[str]]) -> list[list[int]]:
        """The best tags of every sequence, by Viterbi over all of them at once."""
        if not sequences:
            return []
        e, sizes = self.scores(sequences)
        t = self.t + allowed()
        best, back = e[:, 0] + t[-1], []
        for j in range(1, e.shape[1]):
            step = best[:, :, None] + t[None, :-1]
            came = step.argmax(axis=1)
            now = step.max(axis=1) + e[:, j]
            on = (j < sizes)[:, None]
            back.append(np.where(on, came, np.arange(len(TAGS))[None]))
            best = np.where(on, now, best)
        tag = best.argmax(axis=1)
        path = [tag]
        for came in reversed(back):
            tag = came[np.arange(len(tag)), tag]
            path.append(tag)
        whole = np.stack(path[::-1], axis=1)
        return [whole[i, :n].tolist() for i, n in enumerate(sizes)]

    def fit(self, sequences: list[list[str]], tags: list[list[int]], rounds: int = 150, rate: float = 0.3, decay: float = 2e-3) -> Field:
        """Maximum likelihood with a quadratic penalty: forward and backward sums in numpy, AdaGrad steps over the whole table."""
        n, sizes = len(sequences), np.array([len(s) for s in sequences])
        longest, k = sizes.max(), len(TAGS)
        rows = [(i, j, [self.index.get(x, -1) for x in names]) for i, s in enumerate(sequences) for j, names in enumerate(sequence_features(s))]
        who = np.array([i * longest + j for i, j, f in rows for _ in f])
        feature = np.array([x for *_, f in rows for x in f])
        gold = np.zeros((n, longest), int)
        for i, x in enumerate(tags):
            gold[i, : len(x)] = x
        on = np.arange(longest)[None] < sizes[:, None]
        hit = np.eye(k)[gold] * on[..., None]
        moves = np.zeros_like(self.t)
        np.add.at(moves, (k, gold[:, 0]), 1)
        for j in range(1, longest):
            np.add.at(moves, (gold[on[:, j], j - 1], gold[on[:, j], j]), 1)
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(rounds):
            e = np.zeros((n * longest, k))
            np.add.at(e, who, self.w[feature])
            e = e.reshape(n, longest, k)
            t = self.t + np.maximum(allowed(), -1e4)
            f = [e[:, 0] + t[-1]]
            for j in range(1, longest):
                step = f[-1][:, :, None] + t[None, :-1]
                m = step.max(axis=1)
                f.append(np.where(on[:, j, None], np.log(np.exp(step - m[:, None]).sum(axis=1)) + m + e[:, j], f[-1]))
            b = [np.zeros((n, k))]
            for j in range(longest - 1, 0, -1):
                step = t[None, :-1] + (e[:, j] + b[-1])[:, None]
                m = step.max(axis=2)
                b.append(np.where(on[:, j, None], np.log(np.exp(step - m[..., None]).sum(axis=2)) + m, b[-1]))
            b = b[::-1]
            m = f[-1].max(axis=1)
            z = np.log(np.exp(f[-1] - m[:, None]).sum(axis=1)) + m
            marginal = np.exp(np.stack(f, 1) + np.stack(b, 1) - z[:, None, None]) * on[..., None]
            expected = np.zeros_like(self.t)
            expected[k] = marginal[:, 0].sum(axis=0)
            for j in range(1, longest):
                both = np.exp(f[j - 1][:, :, None] + t[None, :-1] + (e[:, j] + b[j])[:, None] - z[:, None, None])
                expected[:k] += (both * on[:, j, None, None]).sum(axis=0)
            dw = -decay * self.w * n
            np.add.at(dw, feature, (hit - marginal).reshape(-1, k)[who])
            dw[-1] = 0
            dt = moves - expected - decay * self.t * n
            gw += dw**2
            gt += dt**2
            self.w += rate * dw / np.sqrt(gw)
            self.t += rate * dt / np.sqrt(gt)
        return self


def train(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """A field from `(text, [(kind, start, end)])`. The table is small by contract, so this runs in the driver."""
    sequences, tags = [], []
    for text, spans in examples:
        for run in windows(text):
            row, last = [], None
            for a, b in run:
                inside = next(((k, s) for k, s, e in spans if s < b and a < e), None)
                row.append(0 if inside is None else TAGS.index(("I-" if inside == last else "B-") + inside[0]))
                last = inside
            sequences.append([text[a:b] for a, b in run])
            tags.append(row)
    index: dict[str, int] = {}
    for s in sequences:
        for names in sequence_features(s):
            for x in names:
                index.setdefault(x, len(index))
    return Field(index).fit(sequences, tags) if sequences else Field(index)


_EDGE = ".,;:!?\"')]}>"


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds beside the base spans: runs of tags that overlap none of them and pass the kind's own check."""
    runs = [(i, run) for i, text in enumerate(texts) for run in windows(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(runs, _paths(texts, runs, field), strict=True):
        j = 0
        while j < len(path):
            if path[j] == 0:
                j += 1
                continue
            k, kind = j + 1, TAGS[path[j]][2:]
            while k < len(path) and TAGS[path[k]] == f"I-{kind}":
                k += 1
            a, b = run[j][0], run[k - 1][1]
            while b > a and texts[i][b - 1] in _EDGE:
                b -= 1
            while a < b and texts[i][a] in "\"'[{<":
                a += 1
            if b > a and plausible(kind, texts[i][a:b]) and not touches(base[i], a, b):
                out[i].append((KINDS.index(kind), a, b))
            j = k
    return out


def touches(spans: list[tuple[int, int, int]], a: int, b: int) -> bool:
    """Whether a..b overlaps one of the spans, which are sorted by kind and start and disjoint within a kind."""
    for k in range(len(KINDS)):
        at = bisect_left(spans, (k, b, 0))
        if at and spans[at - 1][0] == k and spans[at - 1][2] > a:
            return True
    return False


def _paths(texts: list[str], runs: list[tuple[int, list[tuple[int, int]]]], field: Field) -> list[np.ndarray]:
    """The tags of every run. A run of over RUN words is decoded in stretches; of a stretch's tags those between its overlaps count."""
    stretches = [(r, lo, min(lo + RUN, len(run))) for r, (_, run) in enumerate(runs) for lo in range(0, len(run), RUN)]
    stretches.sort(key=lambda x: x[2] - x[1])
    paths = [np.zeros(len(run), np.int8) for _, run in runs]
    step = max(1, CELLS // (RUN + 2 * OVERLAP))
    for first in range(0, len(stretches), step):
        some = stretches[first : first + step]
        ends = [(max(0, lo - OVERLAP), min(len(runs[r][1]), hi + OVERLAP)) for r, lo, hi in some]
        words = [[texts[runs[r][0]][a:b] for a, b in runs[r][1][x:y]] for (r, _, _), (x, y) in zip(some, ends, strict=True)]
        for (r, lo, hi), (x, _), path in zip(some, ends, field.decode(words), strict=True):
            paths[r][lo:hi] = path[lo - x : hi - x]
    return paths


def plausible(kind: str, match: str) -> bool:
    digits = _DIGITS.sub("", match)
    if kind == "email":
        return "@" in match or bool(re.search(r"\bat\b.*\bdot\b", match, re.I))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", match.strip("[]()"))
        return len(parts) == 4 and all(p and valid("ip", p) for p in parts)
    return valid(kind, match) if kind == "card" else 7 <= len(digits) <= 15


def find_pii(docs: DataFrame, field: Field, redacted: bool = False) -> DataFrame:
    """Personal data in every row's whole text.

    Returns `(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`: counts and the digest are of the base
    patterns' spans; `spans` also holds the field's. Both join `kind:start:end` by kind, then start, with commas. With
    `redacted`, also `clean`: the text with every span replaced by its kind in brackets. Null and empty texts have no
    spans (null stays null in `clean`). Repeated rows and ids each give a row; other columns are dropped; no rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _run(it, shared, redacted), schema + (", clean string" if redacted else ""))


def _run(batches: Iterator[pa.RecordBatch], shared, redacted: bool) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = texts_of(batch)
        base = [base_spans(x) for x in texts]
        every = [sorted(b + a) for b, a in zip(base, added_spans(texts, base, shared.value), strict=True)]
        line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        out = {"doc_id": batch.column("doc_id").cast(pa.int64())}
        out |= {f"n_{kind}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS)}
        out |= {"base_sha256": pa.array([hashlib.sha256(line(b).encode()).hexdigest() for b in base]), "spans": pa.array([line(s) for s in every])}
        if redacted:
            out["clean"] = pa.array([None if raw is None else redact(raw, s) for raw, s in zip(batch.column("text").to_pylist(), every, strict=True)], pa.string())
        yield pa.RecordBatch.from_pydict(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind in brackets; where spans of two kinds overlap, their union by the first's kind."""
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k]}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def redact_documents(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with every span of its texts replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    Null texts stay null; rows, and all other columns, stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch)
            base = [base_spans(x) for x in texts]
            added = added_spans(texts, base, shared.value)
            clean = [None if raw is None else redact(raw, sorted(b + a)) for raw, b, a in zip(batch.column("text").to_pylist(), base, added, strict=True)]
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(clean, pa.string())}
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([n if x is None else len(x) for x, n in zip(clean, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
