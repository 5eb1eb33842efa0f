"""PII: pattern detectors, then information-theoretic sanitisation by corpus co-occurrence.

Addresses and numbers found by pattern are the protected entities. Every word of a text that mentions one, outside the
spans found by pattern, is a candidate term. Over the corpus, a term is weighed by how strongly it gives an entity away:
the posterior p(entity | term), from the texts that show both, over the texts with the term, and its pointwise mutual
information with the entity in bits. All counts are of distinct texts, so that copies count once. Terms at or above both
thresholds, with enough support, are spans of kind ``term`` wherever they stand in a text that mentions that entity. In
texts that don't mention it a term is a span only where it points to the entity by itself: it is always written as a
name (capitalised in every text that shows both), and its posterior is at least ``elsewhere``. Sanitising replaces
spans by their kind.

Document frequencies cover the whole corpus: a fixed-size filter of the candidates only spares counting other words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .shared import bounded_batches, quoted, saved, table
from .words import as_bytes

# Kinds in order, and their patterns. The look-behinds only skip starts inside a run of digits, where a
# match can't begin; they keep the scan linear in very long runs.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @, the longest local part before it that no earlier match covers."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text) if _DOTTED.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Word spans that overlap no base span (``spans``, by start)."""
    k = covered = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][0] < e:
            covered = max(covered, spans[k][1])
            k += 1
        if covered <= s:
            yield s, e


def _forms(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    return {text[s:e] for s, e in _outside(text, spans)} if spans else set(_WORD.findall(text))


def _words(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    return {w.lower() for w in _forms(text, spans)}


def _marked_words(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The words, lower-cased, a line each; a blank before those that the text always writes with a capital."""
    forms = _forms(text, spans)
    small = {w.lower() for w in forms if not w[0].isupper()}
    return "\n".join(w if w in small else f" {w}" for w in {w.lower() for w in forms})


def _value(kind: str, text: str) -> int:
    """The protected entity of a mention, as a hash: letter case and separators don't matter."""
    text = text.lower() if kind == "email" else text if kind == "ip" else re.sub(r"[^0-9]", "", text)
    return xxhash.xxh3_64_intdigest(f"{kind}:{text}") - 2**63


_SCAN = "doc_id bigint, uid string, text_hash bigint, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<bigint>, words string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text, and of one with any: its entities and its words, a line each."""
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        base, entities, words = [], [], []
        for raw in as_bytes(batch.column("text")):
            text = (raw or b"").decode("utf-8", "replace")
            spans = base_spans(text)
            for i, k in enumerate(KINDS[:4]):
                counts[i].append(sum(s[2] == k for s in spans))
            base.append(joined(spans))
            entities.append(sorted({_value(kind, text[a:b]) for a, b, kind in spans}))
            words.append(_marked_words(text, spans) if spans else "")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(words, pa.string())], names=["doc_id", "uid", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "words"])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _frequencies(held: Bloom, copied: Bloom) -> Callable:
    """(term, text_hash, n): the texts of a batch that hold a term, as one number where no copy of them can be elsewhere,
    and by text (n = 1) where ``copied`` may hold it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            found: dict[str, int] = {}
            again: dict[int, list[str]] = {}
            hashes = batch.column("text_hash").to_numpy()
            for raw, h, more in zip(as_bytes(batch.column("text")), hashes.tolist(), copied.may_hold(hashes.view(np.uint64)).tolist(), strict=True):
                if h in again:
                    continue
                text = (raw or b"").decode("utf-8", "replace")
                words = _words(text, base_spans(text))
                if new := [w for w in words if w not in known]:
                    if len(known) > 500_000:
                        known.clear()
                        new = list(words)
                    known |= zip(new, held.may_hold(np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)).tolist(), strict=True)
                if more:
                    again[h] = [w for w in words if known[w]]
                    continue
                for w in words:
                    if known[w]:
                        found[w] = found.get(w, 0) + 1
            each = [(w, h) for h, words in again.items() for w in words]
            yield pa.RecordBatch.from_pydict({"term": pa.array([*found, *(w for w, _ in each)], pa.string()), "text_hash": pa.array([None] * len(found) + [h for _, h in each], pa.int64()), "n": pa.array([*found.values(), *(1 for _ in each)], pa.int64())})

    return f


def _places(texts: Bloom, terms: Bloom, names: Bloom) -> Callable:
    """(uid, text_hash, term, start, stop): all occurrences of ``terms`` in ``texts``, and of ``names`` in any, by the filters."""
    everywhere = names.any()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy()
            told = texts.may_hold(hashes.view(np.uint64))
            at = np.arange(len(hashes)) if everywhere else np.flatnonzero(told)
            for own, u, h, raw in zip(told[at].tolist(), batch.column("uid").take(pa.array(at)).to_pylist(), hashes[at].tolist(), as_bytes(batch.column("text").take(pa.array(at))), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                spans = list(_outside(text, base_spans(text)))
                words = [text[s:e].lower() for s, e in spans]
                found = list(set(words))
                keys = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
                ok = set(np.array(found, object)[names.may_hold(keys) | terms.may_hold(keys) & own])
                rows = [(w, s, e) for w, (s, e) in zip(words, spans, strict=True) if w in ok]
                if rows:
                    w, s, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"uid": pa.array([u] * len(w), pa.string()), "text_hash": pa.array([h] * len(w), pa.int64()), "term": pa.array(w, pa.string()), "start": pa.array(s, pa.int32()), "stop": pa.array(e, pa.int32())})

    return f


def _term_hashes(terms: DataFrame) -> DataFrame:
    """The hash that ``_frequencies`` looks up, of the only column."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([xxhash.xxh3_64_intdigest(t) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64))})

    return terms.mapInArrow(f, "h long")


def _uid(docs: DataFrame) -> F.Column:
    """128 bits of a row's id and text: rows with one uid have the same spans."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("bigint").cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"].cast("string"), F.lit(""))))


def disclosures(texts: DataFrame, docs: DataFrame, copies: DataFrame, *, posterior: float, bits: float, support: int, elsewhere: float) -> tuple[DataFrame, DataFrame]:
    """(text_hash, term): the terms of a text that exceed the thresholds for an entity it mentions; and (term): the names
    whose posterior is ``elsewhere`` or more.

    ``texts`` has text_hash, entities and words of every distinct text with an entity, ``copies`` the number ``c`` of rows
    of every text_hash. All counts are of distinct texts. Entities that can't reach the thresholds, whatever they stand
    with, are left out before they are paired: no more texts show both than show either. A term is counted in the whole corpus
    only if it exceeds the thresholds among the texts with an entity, which hold it at most as often.
    """
    n = copies.count()
    each = texts.select("text_hash", F.explode("entities").alias("entity"))
    own = each.groupBy("entity").agg(F.count("*").alias("of_entity")).where((F.col("of_entity") >= support) & (F.log2(F.lit(float(n)) / F.col("of_entity")) >= bits))
    known = each.join(own, "entity").join(texts.select("text_hash", "words"), "text_hash")
    near = saved(known.select("text_hash", "entity", "of_entity", F.explode(F.split("words", "\n")).alias("term")).where("term <> ''").withColumns({"name": F.startswith("term", F.lit(" ")), "term": F.ltrim("term")}))
    exceeds = lambda having: (F.col("both") / F.col(having) >= posterior) & (F.log2(F.col("both") / F.col(having) * n / F.col("of_entity")) >= bits)
    seen = texts.select(F.explode(F.transform(F.split("words", "\n"), lambda w: F.ltrim(w))).alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    pairs = saved(near.groupBy("entity", "term", "of_entity").agg(F.count("*").alias("both"), F.bool_and("name").alias("name")).where(F.col("both") >= support).join(seen, "term").where(exceeds("least")).drop("least"))
    held = bloom_of(_term_hashes(pairs.select("term").distinct()))
    rows = docs if held.any() else docs.limit(0)  # no candidate: no term to count
    counts = rows.select("text", "text_hash").mapInArrow(_frequencies(held, bloom_of(copies.where("c > 1").select("text_hash"))), "term string, text_hash bigint, n long")
    counts = counts.groupBy("term", "text_hash").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("having"))
    told = saved(pairs.join(counts, "term").where(exceeds("having")))
    names = told.where(F.col("name") & (F.col("both") >= elsewhere * F.col("having"))).select("term").distinct()
    return near.join(told.select("entity", "term"), ["entity", "term"], "left_semi").select("text_hash", "term").distinct(), names


def find(docs: DataFrame, *, posterior: float = 0.2, bits: float = 4.0, support: int = 3, elsewhere: float = 0.5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, uid (of the row's id and text), the counts by kind, ``base``
    (base spans) and ``spans`` (all spans), as ``kind:start:end`` by start, then kind.

    Null and empty texts have no spans. Repeated rows have the same spans each. Copies of one text are one piece of
    evidence. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"uid": _uid(docs), "text_hash": F.xxhash64("text")})
    scan = saved(docs.mapInArrow(_scan, _SCAN))
    copies = saved(scan.groupBy("text_hash").agg(F.count("*").alias("c")))
    texts = saved(scan.where(F.size("entities") > 0).select("text_hash", "entities", "words").dropDuplicates(["text_hash"]))
    told, names = map(saved, disclosures(texts, docs, copies, posterior=posterior, bits=bits, support=support, elsewhere=elsewhere))
    terms = bloom_of(_term_hashes(told.select("term").distinct()))
    rows = docs if terms.any() else docs.limit(0)
    places = saved(rows.mapInArrow(_places(bloom_of(told.select("text_hash").distinct()), terms, bloom_of(_term_hashes(names))), "uid string, text_hash bigint, term string, start int, stop int"))
    mine = places.join(told, ["text_hash", "term"], "left_semi").unionByName(places.join(names, "term", "left_semi"))
    more = mine.select("uid", "start", "stop").distinct().groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    both = scan.join(more.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).cast("int").alias("kind"), F.split(x, ":")[2].cast("int").alias("stop")))
    terms = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,stop:int>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["stop"].alias("stop")))
    text = F.array_join(F.transform(F.array_sort(F.concat(base, terms)), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return both.select("doc_id", "uid", "n_email", "n_ip", "n_card", "n_phone", "base", text.alias("spans"))


def redact(text: str, spans: str) -> str:
    """``text`` with spans replaced by ``<kind>``; spans that overlap are one, of the kind that starts first."""
    out, at = [], 0
    for s in spans.split(",") if spans else ():
        kind, a, b = s.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` (any columns) with every span in ``text`` replaced by its kind.

    Null texts stay null, repeated rows stay repeated, an empty table stays empty; other columns may have any name.
    """

    @F.pandas_udf("string")
    def f(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or not s else redact(t, s))

    found = find(docs, **parameters).where("spans <> ''").select(F.col("uid").alias("_uid"), F.col("spans").alias("_spans")).distinct()
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(map(quoted, docs.columns))), _uid(docs).alias("_own"))  # so that no name clashes
    x = own.join(found, F.col("_own") == F.col("_uid"), "left")
    text = f"c{docs.columns.index('text')}"
    clean = F.when(F.col("_spans").isNotNull(), f(text, "_spans")).otherwise(F.col(text))
    return x.select(*((clean if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; null and empty texts have none, and the digest of the empty string."""
    out = find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
