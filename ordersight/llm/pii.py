"""Information-theoretic sanitisation of personal data.

1. *Base entities*: e-mail addresses, IP addresses, card and phone numbers are
   found by fixed patterns in every whole text.
2. *Corpus co-occurrence*: each distinct word is counted over the whole corpus,
   and each (word, entity value) pair over the words within ``reach`` words of
   an occurrence of the entity, outside any base span. A word is a run of at
   least two letters and digits, so user names and numbers count too.
   ``p(entity | word)`` is the share of the word's occurrences that stand next to
   the entity, smoothed by ``prior`` occurrences elsewhere that nobody has seen
   yet: ``n / (n_word + prior)``, so one sighting is weak evidence and no floor
   of sightings is needed. The pointwise mutual information in bits says how
   much more likely the word makes the entity. A word *discloses* an entity if
   the posterior is at least ``generalise_at`` and either the information is at
   least ``min_bits`` or the posterior at least ``remove_at`` (an entity that a
   source repeats everywhere leaves little information to gain).
3. *Sanitisation*: base entities give way to a label of their kind, disclosing
   words to a general label, or to nothing from a posterior of ``remove_at`` on.

Counts are pre-aggregated in the tasks and shuffled by word, so a frequent word
is one row a task. The table of disclosing words is broadcast if it is counted
to have at most ``max_broadcast`` rows; beyond that each document gets its own
words by a join, with the same result.

Defined cases: a null text is an empty one and stays null when sanitised. A
null id is kept. Repeated rows are documents of their own and count as often as
they occur. An empty table gives no rows and no disclosing words. Columns other
than id and text are not read, and are kept as they are by ``sanitise``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_text, map_rows, releasing

#: Fixed by the task: kinds in the order of the digests, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]{2,}")
_COUNTED = 250_000


def _emails(text: str) -> list[tuple[int, int]]:
    """Every match has its '@' right after the run it starts in, so one look at each '@' is enough."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each maximal dotted run, from its left."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            out += [(kind, a, b) for a, b in find(text)]
    return out


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _near(text: str, spans: list[tuple[str, int, int]], reach: int):
    """``(word, entity)`` for the words within ``reach`` words of each base span, outside all of them."""
    covered = _union(spans)
    begins = [a for a, _ in covered]
    words = [m.span() for m in _TERM.finditer(text)]
    starts = [s for s, _ in words]
    for kind, a, b in spans:
        entity = f"{kind}:{text[a:b].lower()}"
        lo, hi = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        for s, e in words[max(0, lo - reach):hi + reach]:
            k = bisect.bisect_left(begins, e) - 1  # the last span that begins before the word ends
            if k < 0 or covered[k][1] <= s:
                yield text[s:e].lower(), entity


def cooccurrence(docs: DataFrame, *, reach: int = 6) -> DataFrame:
    """``(word, entity, n)``: occurrences of words next to entities; a null entity has those in all texts."""
    schema = [("word", pa.string(), "string"), ("entity", pa.string(), "string"), ("n", pa.int64(), "long")]

    def run(it):
        words, pairs = Counter(), Counter()
        for batch in it:
            for text in batch.column(1):
                text = text.as_py()
                if text:
                    words.update(_TERM.findall(text.lower()))
                    spans = base_spans(text)
                    if spans:
                        pairs.update(_near(text, spans, reach))
                if len(words) + len(pairs) > _COUNTED:
                    yield from ((w, None, n) for w, n in words.items())
                    yield from ((w, e, n) for (w, e), n in pairs.items())
                    words.clear(), pairs.clear()
        yield from ((w, None, n) for w, n in words.items())
        yield from ((w, e, n) for (w, e), n in pairs.items())

    return map_rows(docs, run, schema, size=20_000).groupBy("word", "entity").agg(F.sum("n").alias("n"))


def disclosing_words(docs: DataFrame, *, reach: int = 6, prior: float = 1.5, generalise_at: float = 0.5,
                     remove_at: float = 0.8, min_bits: float = 8.0) -> DataFrame:
    """``(word, posterior)`` of the words that disclose an entity, with the highest posterior of each."""
    counts = materialize(cooccurrence(docs, reach=reach), "pii_counts")
    words = counts.where(F.col("entity").isNull()).select("word", F.col("n").alias("n_word"))
    pairs = counts.where(F.col("entity").isNotNull())
    entity = pairs.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    total = counts.where(F.col("entity").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    # Both shares are of word occurrences: those beside the entity, and all.
    seen = (pairs.join(words, "word")
            .withColumn("posterior", F.least(F.lit(1.0), F.col("n") / (F.col("n_word") + F.lit(float(prior)))))
            .where(F.col("posterior") >= generalise_at).join(entity, "entity")
            .withColumn("bits", F.log2(F.col("posterior") * F.lit(float(total)) / F.col("n_entity"))))
    return (seen.where((F.col("bits") >= min_bits) | (F.col("posterior") >= remove_at))
            .groupBy("word").agg(F.max("posterior").alias("posterior")))


def _find(text: str, disclosing: dict[str, float], remove_at: float) -> list[tuple[str, int, int]]:
    """Base spans, then ``term`` (to be generalised) and ``drop`` (to be removed) spans outside them."""
    spans = base_spans(text)
    if not disclosing:
        return spans
    covered, more, k = _union(spans), [], 0
    low = text.lower()
    if disclosing.keys().isdisjoint(_TERM.findall(low)):
        return spans
    same = len(low) == len(text)  # else offsets in the lower-case text would not hold
    for m in _TERM.finditer(low if same else text):
        p = disclosing.get(m[0] if same else m[0].lower())
        if p is None:
            continue
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            more.append(("drop" if p >= remove_at else "term", *m.span()))
    return spans + [s for s in more if s[0] == "term"] + [s for s in more if s[0] == "drop"]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _known(docs: DataFrame, max_broadcast: int, options: dict):
    """The disclosing words: ``(table, broadcast)``, where the broadcast is None if there are too many."""
    table = materialize(disclosing_words(docs, **options), "pii_words")
    if table.count() > max_broadcast:
        return table, None
    return table, docs.sparkSession.sparkContext.broadcast({r.word: r.posterior for r in table.collect()})


def _own_words(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """``(row, own)``: the disclosing words of each ``(row, text)``, found by a join."""
    def run(it):
        for batch in it:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from ((row, w) for w in set(_TERM.findall((text.as_py() or "").lower())))

    words = map_rows(keyed, run, [("row", pa.int64(), "long"), ("word", pa.string(), "string")], size=20_000)
    return words.join(table, "word").groupBy("row").agg(F.collect_list(F.struct("word", "posterior")).alias("own"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.8,
         max_broadcast: int = 200_000, **options) -> DataFrame:
    """``doc_id, spans`` of every document.

    ``spans``: ``(kind, start, end)`` in code points; kinds email, ip, card, phone, term, drop.
    """
    slim = id_text(docs, id_col, text_col)
    table, known = _known(slim, max_broadcast, {**options, "remove_at": remove_at})
    schema = [("doc_id", pa.int64(), "long"), ("spans", _ARROW_SPANS, SPANS)]

    def run(it):
        for batch in it:
            own = repeat(None) if known else batch.column(2)
            for doc_id, text, words in zip(batch.column(0).to_pylist(), batch.column(1), own):
                spans = _find(text.as_py() or "", known.value if known else _as_dict(words), remove_at)
                yield doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    if known is None:
        keyed = slim.withColumn("row", F.monotonically_increasing_id())
        slim = keyed.join(_own_words(keyed.select("row", "text"), table), "row", "left").select("doc_id", "text", "own")
    return map_rows(slim, run, schema)


def _as_dict(own: pa.Scalar) -> dict[str, float]:
    return {x["word"]: x["posterior"] for x in own.as_py() or ()}


def sanitise(docs: DataFrame, *, text_col: str = "text", remove_at: float = 0.8, max_broadcast: int = 200_000,
             **options) -> DataFrame:
    """The documents with their spans replaced in the text; all other columns stay as they are."""
    slim = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table, known = _known(slim, max_broadcast, {**options, "remove_at": remove_at})
    kinds = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    at, extra = docs.columns.index(text_col), "__llm_own"

    def run(it):
        for batch in it:
            own = repeat(None) if known else batch.column(batch.num_columns - 1)
            new = []
            for text, words in zip(batch.column(at).to_pylist(), own):
                spans = _find(text or "", known.value if known else _as_dict(words), remove_at)
                new.append(text if text is None else redact(text, spans))
            columns = list(batch.columns)[:len(kinds_names)]
            columns[at] = pa.array(new, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=kinds_names)

    kinds_names = kinds.columns
    if known is None:
        row = "__llm_row"
        keyed = kinds.withColumn(row, F.monotonically_increasing_id())
        own = (_own_words(keyed.select(row, text_col), table).withColumnsRenamed({"row": row, "own": extra}))
        return keyed.join(own, row, "left").drop(row).mapInArrow(lambda it: releasing(run(it)), kinds.schema)
    return kinds.mapInArrow(lambda it: releasing(run(it)), kinds.schema)


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by labels; overlapping spans become one, with the first one's label."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], LABELS[k]]
        done = max(done, b)
    return "".join([*out, text[done:]])
