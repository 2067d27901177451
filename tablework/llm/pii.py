"""Personal data: a BiLSTM-CRF over characters beside fixed patterns (operator 8).

The fixed patterns (``base_spans``) mark emails, IP addresses, payment cards
and phone numbers.  A tagger is trained in numpy from labelled spans - a
bounded sample of windows around possible places, with rewritten copies of
their spans ("name (at) host (dot) org", numbers in other groupings) - and
adds the spans the patterns miss.

Every text is scanned whole for possible places: a digit, an at sign or a
bracketed "at".  A span of any kind holds one, so text without one is not
given to the tagger.  Around them overlapping windows are decoded; where
windows overlap a character takes its tag from the window in which it is
furthest from an end, and spans are read from the whole text's tags.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.pii_tagger import KINDS, Tagger, classes, spans_of, tags_of
from tablework.llm.store import aside, bounded_sample, prepare, table

SAMPLE = 1_500      # windows the tagger is trained on
WIDTH = 96          # characters of a window
STRIDE = 48         # characters between windows of a stretch
AROUND = 32         # characters taken on either side of a possible place
LANES = 1024        # windows decoded together

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLACE = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.I)
_AT = re.compile(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) by kind, then start: leftmost matches that do
    not overlap within a kind.  Linear in the text: an email is sought from
    its at sign, and a failed run of digits is not tried again from inside
    (no later start in it can match)."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and _LOCAL.match(text, s - 1):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the stretches around possible places."""
    stretches: list[list[int]] = []
    for m in _PLACE.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        s = a
        while True:
            out.append((s, min(s + WIDTH, b)))
            if s + WIDTH >= b:
                break
            s += STRIDE
    return out


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window with some of its spans in another spelling, and their places."""
    out, new, end, shift = [], [], 0, 0
    for k, s, e in sorted(spans, key=lambda x: x[1]):
        if s < end:
            continue
        old = text[s:e]
        word = old
        if rng.random() < 0.6:
            if KINDS[k] == "email":
                at, dot = ((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), ("@", "."))[rng.integers(5)]
                name, _, host = old.partition("@")
                word = name + at + host.replace(".", dot)
            elif KINDS[k] == "phone":
                digits = re.sub(r"[^0-9]", "", old)
                word = (f"00{digits}", f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"+{digits}",
                        f"{digits[:3]}-{digits[3:6]}-{digits[6:]}")[rng.integers(4)]
            elif KINDS[k] == "card":
                digits = re.sub(r"[^0-9]", "", old)
                gap = ("", " ", "-", ".")[rng.integers(4)]
                word = gap.join(digits[i:i + 4] for i in range(0, len(digits), 4))
        out.append(text[end:s] + word)
        new.append((k, s + shift, s + shift + len(word)))
        shift += len(word) - len(old)
        end = e
    out.append(text[end:])
    return "".join(out), new


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 160, seed: int = 7) -> Tagger | None:
    """Fit a tagger on windows with labelled spans; None without any span."""
    if not any(s for _, s in labelled):
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, spans in labelled:
        for t, sp in ((text, spans), rewritten(text, spans, rng)):
            t = t[:WIDTH]
            x.append(classes(t, WIDTH))
            y.append(tags_of([(k, s, min(e, WIDTH)) for k, s, e in sp if s < WIDTH], WIDTH))
    tagger = Tagger()
    tagger.fit(np.array(x), np.array(y), steps)
    return tagger


def plausible(kind: int, word: str) -> bool:
    """What a tagged span must hold to be personal data of its kind."""
    digits = sum("0" <= c <= "9" for c in word)
    if KINDS[kind] == "email":
        return len(_AT.findall(word)) == 1 and bool(re.search(r"[A-Za-z0-9]\s?(\.|[(\[{]\s?dot\s?[)\]}])\s?[A-Za-z]", word, re.I)) \
            and word[0].isalnum() and word[-1].isalnum()
    if not re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", word):
        return False
    if KINDS[kind] == "ip":
        parts = word.split(".")
        return len(parts) == 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return 13 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", word))
    return 9 <= digits <= 15 and bool(re.search(r"^[+(]|^00|[ .-]", word))


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Plausible spans the tagger marks in each text."""
    jobs = [(d, a, b) for d, t in enumerate(texts) for a, b in windows(t)]
    marks: dict[int, dict[int, tuple[int, int]]] = {}
    for i in range(0, len(jobs), LANES):
        part = jobs[i:i + LANES]
        tags = tagger.decode(np.array([classes(texts[d][a:b], WIDTH) for d, a, b in part]))
        for (d, a, b), row in zip(part, tags):
            whole = len(texts[d])
            got = marks.setdefault(d, {})
            for j in range(b - a):
                # distance to an end of the window that is no end of the text
                depth = min(j if a else WIDTH, b - a - 1 - j if b < whole else WIDTH)
                if a + j not in got or got[a + j][0] < depth:
                    got[a + j] = (depth, int(row[j]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, got in marks.items():
        places = sorted(got)
        k = 0
        while k < len(places):
            e = k
            while e + 1 < len(places) and places[e + 1] == places[e] + 1:
                e += 1
            row = np.array([got[p][1] for p in places[k:e + 1]])
            for kind, s, z in spans_of(row):
                s, z = places[k] + s, places[k] + z
                word = texts[d][s:z]
                s += len(word) - len(word.lstrip())
                z -= len(word) - len(word.rstrip())
                inside = (s == 0 or not texts[d][s - 1].isalnum()) and (z == len(texts[d]) or not texts[d][z:z + 1].isalnum())
                if s < z and inside and plausible(kind, texts[d][s:z]):
                    out[d].append((kind, s, z))
            k = e + 1
    return out


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; a tagged span that touches any
    base span is not added."""
    some = [i for i, t in enumerate(texts) if _PLACE.search(t)]
    base: list[list] = [[] for _ in texts]
    both: list[list] = [[] for _ in texts]
    for i in some:
        base[i] = both[i] = base_spans(texts[i])
    if tagger is not None and some:
        for i, more in zip(some, tagged(tagger, [texts[i] for i in some])):
            new = [m for m in more if all(m[2] <= s or e <= m[1] for _, s, e in base[i])]
            if new:
                both[i] = sorted([*base[i], *new])
    return list(zip(base, both))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _labelled(batches) -> Iterator[pa.RecordBatch]:
    """Windows around possible places with their base spans, as training rows."""
    for b in batches:
        rows = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not t or not _PLACE.search(t):
                continue
            spans = base_spans(t)
            for a, z in windows(t):
                rows.append((d, a, t[a:z], joined([(k, s - a, e - a) for k, s, e in spans if a <= s and e <= z])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             names=["doc_id", "at", "text", "spans"])


def parsed(spans: str) -> list[tuple[int, int, int]]:
    return [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """Train on ``sample`` windows: half with spans, half without where there
    are enough, chosen by a hash of their text."""
    got = docs.mapInArrow(_labelled, "doc_id long, at long, text string, spans string").select("text", "spans").distinct() \
        .withColumn("some", F.col("spans") != "")
    n = {r["some"]: r["count"] for r in got.groupBy("some").count().collect()}
    halves = [bounded_sample(got.where(F.col("some") == s), ["text", "spans"], sample // 2, n.get(s, 0)) for s in (True, False)]
    rows = halves[0].unionByName(halves[1]).orderBy(F.desc("some"), F.xxhash64("text"), "text").collect()
    return train([(r.text, parsed(r.spans)) for r in rows])


def find(docs: DataFrame, keep: list[str], tagger: Tagger | None, make, fields: str) -> DataFrame:
    """Apply ``make(text, base, all)`` to each text: the ``keep`` columns + its fields."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [F.col(f"`{c}`") for c in keep]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema) + fields
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            raw = b.column(0).to_pylist()
            texts = [t or "" for t in raw]
            rows = [make(t, base, both) for t, (base, both) in zip(raw, all_spans(held.value, texts))]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, ty) for c, ty in zip(cols, kinds))],
                                             names=[*keep, *names])

    return docs.select(F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, ddl)


def _digest(text, base, both):
    n = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both))


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans), one row per row.  The counts and the digest are of
    the base spans; ``spans`` has the tagger's too.  Null and empty texts have
    no spans; ids may be null or repeated."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return find(docs, ["doc_id"], fit(docs, sample), _digest,
                "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each span (overlapping ones as one) replaced by its kind in brackets."""
    if not spans:
        return text
    out, end = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every whole text of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans are replaced in the texts; n_chars follows."""
    prepare(spark)
    cols, names = aside(docs)
    tagger = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = find(docs.select(F.col("text").cast("string").alias("text"), *cols), list(names), tagger,
               lambda t, base, both: ((r := redacted(t, both)), None if r is None else len(r)), "new_text string, new_chars long")
    new = {"text": "new_text", "n_chars": "new_chars"}
    return out.select(*[F.col(new.get(c, n)).alias(c) for n, c in names.items()])
