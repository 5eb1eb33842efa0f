"""The ten operators and the pipeline: SQL on the smallest tables, brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import pickle
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bloom, chat, decontaminate, importance, jaccard_join, language, mixing, pii, quality_rules, queries, shared, substring_dedup, url_filters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, repeated rows, and columns that clash with inner names."""
    base = " ".join(f"w{i}" for i in range(60)) + "."
    data = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, None, None, None), (3, None, "en", "a", 0), (4, "", None, "b", 0), (None, base, "en", "b", 1), (5, "..", "de", "b", 2), (6, "x" * 200_000, "de", "b", 1), (7, "y z " * 30_000, "fr", "c", 1), (8, base + " tail", "en", "c", 1)]
    return spark.createDataFrame(data, DOCS).withColumns({c: F.lit("clash") for c in ("uid", "sig", "chunk", "size", "h", "key", "component")})


def table(spark, name):
    return shared.table(spark, SF, name)


def texts(spark, name="documents"):
    return {r.doc_id: r.text for r in table(spark, name).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in columns) for r in queries.QUERIES[name](spark, SF).collect())
    assert got == sorted(tuple(map(show, r)) for r in want.fetchall())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_documents(spark, odd, empty):
    docs = odd.limit(0) if empty else odd
    n = 0 if empty else 10
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", " ".join(f"W{i}" for i in range(12))), (None, None), ("e", "")], "item_id string, text string")
    assert jaccard_join.similar(docs).count() == n
    assert decontaminate.contamination(docs, items).count() == n
    assert decontaminate.contamination(docs, items.limit(0)).where("size(_hits) > 0").count() == 0
    assert quality_rules.clean_lines(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert importance.weighed(docs, labels)[0].count() == n
    assert pii.find(docs).count() == n
    assert pii.sanitised(docs).columns == docs.columns
    assert substring_dedup.without_repeated_passages(docs).count() == n
    assert language.identify(docs, learn_where=F.lit(True)).count() == n


def test_odd_results(spark, odd):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similar(odd).collect()}
    assert {(1, 1, 4), (2, 1, 4), (None, 1, 4), (8, 1, 4), (3, 3, 0), (4, 4, 0)} <= got
    one = jaccard_join.one_of_each(odd).select("doc_id").collect()
    assert Counter(r[0] for r in one) == Counter([1, 3, 4, 5, 6, 7])
    kept = {(r.doc_id, r.n_removed) for r in substring_dedup.without_repeated_passages(odd).collect()}
    assert {(1, 0), (2, 60), (None, 0), (8, 60), (3, 0)} <= kept
    assert {r.lang_pred for r in language.identify(odd, learn_where=F.lit(True)).where("doc_id IN (3, 4, 5)").collect()} == {"und"}


def test_jaccard_by_brute_force(spark):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(WORD, t)) else set() for i, t in texts(spark).items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    up, links = {i: i for i in sets}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j > i).items():
            if n >= 0.8 * len(s | sets[j]):
                links.update((i, j))
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.op1_ngram_jaccard_join(spark, SF).collect()}
    assert got == {(i, root(i), links[i]) for i in sets}


def test_large_buckets_are_split(spark):
    """A group of near copies larger than the bucket limit and the block keeps all links."""
    base = [f"b{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"e{k}"])) for k in range(40)], "doc_id long, text string")
    got = jaccard_join.similar(docs, limit=8).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_codings_of_windows_are_reversible():
    draw = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 2**32), (7, 3), (5_000, 2**32), (5_000, 900)):
        x = np.sort(draw.integers(0, top, n, dtype=np.uint32))
        assert (substring_dedup._decoded(substring_dedup._coded(x)) == x).all()
    for least in (0, -5, 2**40):
        x = np.zeros(9, substring_dedup._EXACT)
        x["h"], x["g"], x["least"], x["most"] = draw.integers(0, 2**64, 9, np.uint64), draw.integers(0, 2**64, 9, np.uint64), least, least + np.arange(9) % 2
        assert (substring_dedup._unpacked(substring_dedup._packed(x), substring_dedup._EXACT) == x).all()
        assert (substring_dedup._unpacked(substring_dedup._packed(x, False), substring_dedup._MARK)["g"] == x["g"] & np.uint64(2**32 - 1)).all()


def test_survival_gives_the_recall():
    assert 0.3 < jaccard_join.survival(4) < jaccard_join.survival(1) < 0.64


def test_chat_round_trip(spark):
    rows = [
        (1, 0, '{"messages":[{"role":"user","content":"a</turn>\\\\"},{"role":"assistant","content":"<turn:x>\\n"}]}'),
        (2, 0, '{"instruction":"i","input":"","output":"o"}'),
        (3, 0, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}'),
        (4, 0, "not json"), (5, 0, None), (6, 0, '{"other":1}'), (7, 0, '{"messages":[]}'), (8, 0, "[" * 100_000),
        (9, 0, '{"messages":[null,"s",{"role":"user","content":"c","name":"n"}]}'),
        (10, 0, '{"id":"x","conversations":[{"from":"human","value":"h"}]}'),
        (11, 0, '{"role":"user","text":"a\\ud800b"}'), (12, 0, '{"messages":"m"}'), (13, 0, "7"), (None, None, '{"prompt":"p","completion":"c"}'),
    ]
    records = spark.createDataFrame(rows, "conv_id long, turn long, record string").withColumns({c: F.lit(0) for c in ("turns", "layout", "text", "_record")})
    df = chat.format_conversations(records)
    got, why = defaultdict(list), {}
    for r in df.orderBy("conv_id", "part").collect():
        if r.rejected:
            why[r.conv_id] = r.rejected
            assert r.segment is None
            continue
        got[r.conv_id] += chat.parse(r.segment)
        assert r.loss_to >= r.loss_from
    assert dict(got) == {
        1: [("user", "a</turn>\\"), ("assistant", "<turn:x>\n")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "h"), ("assistant", "")],
        9: [("", ""), ("", "s"), ("user", "c")], 10: [("user", "h")], 11: [("user", "a\ufffdb")], 12: [("", "m")], None: [("user", "p"), ("assistant", "c")],
    }
    assert why == {4: "not JSON", 5: "null", 6: "unknown layout", 7: "no turns", 8: "nested too deep", 13: "unknown layout"}
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)
    back = {r.conv_id: (r.n_turns, r.n_rejected) for r in chat.read_back(df).collect()}
    assert back[4] == (0, 1) and back[None] == (2, 0) and len(back) == len(rows)
    assert chat.read_back(chat.format_conversations(records.limit(0))).count() == 0


def test_every_layout_is_met(spark):
    """What op3 feeds its mappings: five layouts, none rejected."""
    conv = table(spark, "conversations").select("conv_id", "turn", "role", "text")
    records = conv.select("conv_id", "turn", chat._record(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))).alias("record"))
    turns = chat.canonical_turns(records, ["conv_id", "turn"])
    assert {r.layout for r in turns.select("layout").distinct().collect()} == {"turn", "turn_content", "messages", "conversations"}
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in turns.collect()) == Counter((r.conv_id, r.turn, r.role, r.text) for r in conv.collect())


def test_quality_rules_by_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    for i, t in texts(spark).items():
        w = re.findall(WORD, t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    assert all(not got[i].kept for i, q in labels.items() if q == 0)
    assert all(got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed)


def test_line_rules():
    f = lambda x: quality_rules.line_fault(x, len(x.split()), long_line=30, furniture_words=20)
    assert f(b"A fine line, as it is.") is None and f(b"BUY!! NOW!! OR!! NEVER!!") == "punctuation"
    assert f(b"home | news | about | contact") == "navigation" and f(b"All rights reserved by us.") == "boilerplate"


def test_mix_is_near_its_targets(spark):
    taken, _, goal = mixing.mixture(table(spark, "documents"))
    by = {r.source: (r.source_size, r.target) for r in goal.collect()}
    out = mixing.mix(table(spark, "documents")).collect()
    total = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        total[r.source] += r.taken
    assert all(abs(total[s] - t) <= 1 for s, (_, t) in by.items())
    assert all(t <= 3 * n + 1e-6 for n, t in by.values()) and abs(sum(t for _, t in by.values()) - sum(n for n, _ in by.values())) < 1e-3
    slots = taken.select("slot", "source", "rank").distinct().collect()
    assert len({r.slot for r in slots}) == len(slots)


def test_intervals(spark):
    e = spark.createDataFrame([("2024-01-01", "add", "A.com"), ("2024-01-05", "remove", "a.com"), (None, "add", "b.com")], "at string, action string, pattern string")
    c = spark.createDataFrame([(u, t) for u in ("http://x.a.com:80/p", "http://aa.com/", None) for t in ("2023-12-31 00:00:00", "2024-01-01 00:00:00", "2024-01-05 00:00:00", None)] + [("http://a.com", "2024-01-02 00:00:00")] * 2, "url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    out = url_filters.screened(c, e).collect()
    assert len(out) == 14 and sum(r.n_active for r in out) == 3
    assert url_filters.screened(c.limit(0), e).count() == 0 and url_filters.screened(c, e.limit(0)).where("n_active > 0").count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = shared.table(spark, sf, "labels")
    out, threshold = importance.weighed(shared.table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"))
    kept = {r.doc_id for r in out.where(F.col("_key") >= threshold()).select("doc_id").collect()}
    rest = [(r.doc_id in kept, r.quality, r.toxic) for r in labels.where("doc_id % 2 = 1").collect()]
    good, junk = [k for k, q, t in rest if q == 1 and t == 0], [k for k, q, _ in rest if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_kth_largest(spark):
    v = spark.createDataFrame([(float(x * x % 97),) for x in range(300)], "v double")
    want = sorted((float(x * x % 97) for x in range(300)), reverse=True)
    assert all(importance.kth_largest(v, "v", k) == want[k - 1] for k in (1, 7, 150, 300))
    assert importance.kth_largest(v.limit(0), "v", 3) == float("inf")


def test_base_spans_by_the_patterns():
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for t in ["a@b.co@c.d.e, x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +12 +1 2", "é a.b@c-d.e\n" * 3, "@@a@b.c", "999999999999.1.1"]:
        want = []
        for k, p in pats.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                    continue
                want.append((m.start(), m.end(), k))
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_disclosing_terms(spark):
    """A rare name that keeps standing beside one address gives it away; common words don't, nor do mere copies."""
    filler = [f"the report of day {i} was long and dull, said one" for i in range(100)]
    told = [f"note {'abcdefgh'[i]}x from Zorblax the writer at z@mail.org about {'qrstuvwx'[i]}y" for i in range(5)]
    copy = ["call Quux at q@mail.org"] * 5
    docs = spark.createDataFrame(list(enumerate(filler + told + copy)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert all("term:13:20" in out[100 + i] for i in range(5)) and not any("term" in out[i] for i in [*range(100), *range(105, 110)])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zorblax" not in clean[100] and "z@mail" not in clean[100] and "<email>" in clean[100] and clean[0] == filler[0]


def test_copies_hide_no_disclosing_term(spark):
    """One of the texts that give an entity away, or one that doesn't mention it, has many copies."""
    filler = [f"the report of day {i} was long and dull, said one" for i in range(100)]
    told = [f"note {'abcdefgh'[i]}x from Zorblax the writer at z@mail.org about {'qrstuvwx'[i]}y" for i in range(5)]
    for more in (told[:1], ["hello Zorblax"]):
        docs = spark.createDataFrame(list(enumerate(told + more * 99 + filler)), "doc_id long, text string")
        out = {r.doc_id: r.spans for r in pii.find(docs).collect()}
        assert all("term:13:20" in out[i] for i in range(5)) and not any("term" in out[i] for i in range(104, 204))


def test_disclosing_terms_far_from_the_mention(spark):
    """Judged by whole texts, and removed all over the texts with the mention."""
    filler = [f"the report of day {i} was long and dull, said one" for i in range(100)]
    far = " and the long report of one dull day was said" * 80
    told = [f"Zorblax{far} {'abcdefgh'[i]}x z@mail.org{far} zorblax" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all(clean[i].lower().count("zorblax") == 0 and clean[i].count("<term>") == 2 for i in range(100, 105))
    assert all(clean[i] == filler[i] for i in range(100))


def test_words_outside_spans():
    text = "Éa.b@c.de x +1 555 123 4567y Straße, 1.2.3.4 z"
    spans = pii.base_spans(text)
    words = [m.span() for m in pii._WORD.finditer(text)]
    assert list(pii._outside(text, spans)) == [(s, e) for s, e in words if not any(s < y and a < e for a, y, _ in spans)]
    assert pii._words(text, spans) >= {"x", "straße", "z"} and not pii._words(text, spans) & {"b", "c", "de"}


def test_sketch_loses_no_window():
    import pyarrow as pa

    cells = np.sort(np.random.default_rng(1).integers(0, 2**32, 5000, np.uint32))
    blobs = pa.table({"chunk": [0, 1], "shard": [0, 0], "cells": [substring_dedup._coded(cells), substring_dedup._coded(cells[::7])]})
    found = substring_dedup._repeated(blobs)
    assert set(cells[::7]) <= set(substring_dedup._decoded(found.column("cells")[0].as_py()))


def test_language_on_held_out(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents").collect()}
    out = [r for r in language.op10_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_pipeline(spark, tmp_path):
    """Each stage against what its operator says of the same input."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = shared.saved(stage(spark, docs, SF))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert ids == {r.class_id for r in jaccard_join.similar(docs).collect()}
        if name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            bad = {tuple(w[i : i + 10]) for r in table(spark, "benchmark").collect() if (w := words(r.text)) for i in range(max(1, len(w) - 9))}
            hit = {i for i, t in before.items() if (w := words(t)) and any(tuple(w[k : k + 10]) in bad for k in range(max(1, len(w) - 9)))}
            assert ids == set(before) - hit
        if name == "privacy":
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) == set(before) and not any(pii.base_spans(t) for t in after.values())
        if name == "quality":
            good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
            assert len(good & set(before) & ids) >= 0.97 * len(good & set(before))
        docs = out
    assert {r.doc_id for r in docs.collect()} == set(before)
    mix = {r.doc_id: r for r in docs.collect()}
    assert all(r.text == before[i] and r.taken == sum(x.to - x["from"] for x in r.slots) and r.taken <= 3 * r.size for i, r in mix.items())
    folder = str(tmp_path)
    assert corpus_pipeline.run(spark, SF, folder).count() == len(before)
    kept = corpus_pipeline.STAGES[:]
    try:  # a resumed run computes nothing again
        corpus_pipeline.STAGES[:] = [(name, None) for name, _ in kept]
        assert corpus_pipeline.run(spark, SF, folder).count() == len(before)
    finally:
        corpus_pipeline.STAGES[:] = kept


def test_digest_of_nothing():
    assert decontaminate.NOTHING_SHA256 == hashlib.sha256(b"").hexdigest()


def test_names_are_removed_elsewhere(spark):
    """A name that gives an address away goes from texts without the address too; a common word in it doesn't."""
    filler = [f"the report of day {i} was long and dull, said one" for i in range(100)]
    told = [f"note {'abcdefgh'[i]}x from Zorblax the writer at z@mail.org about {'qrstuvwx'[i]}y" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(filler + told + ["ask Zorblax, who is at home", None, ""])), "doc_id long, text string").withColumns({c: F.lit(0) for c in ("_uid", "_spans", "_own", "c0", "uid")})
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[105] == "ask <term>, who is at home" and got[106] is None and got[107] == "" and all(got[i] == filler[i] for i in range(100))


def test_pii_of_odd_rows(spark, odd):
    out = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base, r.spans) for r in pii.find(odd).collect())
    assert out == Counter({(1, 0, 0, 0, 0, "", ""): 2, **{(i, 0, 0, 0, 0, "", ""): 1 for i in (2, 3, 4, None, 5, 6, 7, 8)}})


def test_recall_near_the_threshold(spark):
    """Pairs just over the threshold, in texts made of passages that many texts share: every bucket is split."""
    draw = np.random.default_rng(4)
    passages = [[f"p{k}w{i}" for i in range(45)] for k in range(70)]
    data, pairs = [], 400
    for k in range(pairs):
        picked = draw.choice(70, 10, replace=False)
        a = [w for p in picked[:9] for w in passages[p]]
        b = [w for p in [*picked[:8], picked[9]] for w in passages[p]]
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([*b[: 8 * 45], *a[8 * 45 : 8 * 45 + 5], *b[8 * 45 :]]))]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    jaccard = [len(a & b) / len(a | b) for k in range(pairs) for a, b in [(grams(data[2 * k][1]), grams(data[2 * k + 1][1]))]]
    assert 0.8 <= min(jaccard) and max(jaccard) < 0.83
    got = {r.doc_id: r.n_links for r in jaccard_join.similar(spark.createDataFrame(data, "doc_id long, text string"), limit=8).collect()}
    assert sum(got[2 * k] > 0 and got[2 * k + 1] > 0 for k in range(pairs)) >= 0.99 * pairs


def test_runs_give_the_recall():
    draw = np.random.default_rng(6)
    runs = jaccard_join.runs_for(0.995)
    met = 0
    for k in range(4000):
        shared = draw.integers(0, 2**64, draw.poisson(jaccard_join.SAMPLE), np.uint64)
        paths = [np.array([(k << 8) + run], np.int64) for run in range(runs)]
        for _ in range(6):  # six levels of splits, of all runs together
            paths = [np.concatenate([jaccard_join._drawn(shared, int(p), jaccard_join.RATE / jaccard_join.SAMPLE) for p in some[:6]] or [np.empty(0, np.int64)]) for some in paths]
        met += any(len(p) for p in paths)
    assert met >= 0.99 * 4000


def test_rows_without_an_id(spark):
    """Copies without a doc_id are one class; one of them stays. Columns may have any name."""
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, base, 1), (None, base, 2), (None, base + " x", 3), (4, "alone", 4), (None, None, 5)], "doc_id long, text string, _first int").withColumns({c: F.lit(0) for c in ("_own", "_did", "sig", "_nth", "c0", "a.b")})
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text and len(r.text) > 9) for r in out.collect()) == Counter([(None, True), (4, False), (None, None)])


def test_weights_by_brute_force(spark):
    """The classifier again, with n-grams as they are instead of hashed, in plain Python."""
    import math

    good = [f"The cat {i} sat on the mat, and it slept well all day long in room {i % 3}." for i in range(30)]
    junk = [f"BUY BUY now!!! $$$ {i} $$$ click click" for i in range(12)]
    toxic = [f"The cat {i} sat on the mat, you utter zorg, and slept in room {i % 3}." for i in range(14)]
    data = [(i, t) for i, t in enumerate([*good, *junk, *toxic, "A cat sat, you zorg.", "click click $$$", "", "Plain words that nobody saw"])]
    labels = [(i, int(i < 30 or i >= 42), int(i >= 42)) for i in range(56)]
    docs = spark.createDataFrame([*data, (99, None)], "doc_id long, text string")
    out, threshold = importance.weighed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    fold = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    shape = lambda w: "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in w[-4:])

    def grams(t):
        f, w = fold(t), t.split()
        near = list(zip(w, w[1:], strict=False))
        return [*(("w", x) for x in f), *(("s", shape(x)) for x in w), *(("ss", shape(a), shape(b)) for a, b in near), *(("t", a == b) for a, b in near)], [("p", a, b) for a, b in zip(f, f[1:], strict=False)]

    kind = {i: 1 if q == 0 else 2 if x else 0 for i, q, x in labels}
    n, d = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for i, t in data:
        if i in kind:
            a, b = grams(t)
            n[kind[i]].update(a + b)
            d[kind[i]].update(set(a))
    total = n[0] + n[1] + n[2]

    def ratio(x, target, raw, smooth, significant=0.0):
        a, b = sum(target.values()), sum(raw.values())
        both = (target[x] + raw[x]) / (a + b)
        if abs(raw[x] - both * b) < significant * math.sqrt(both * b * a / (a + b) + 0.5):
            return 0.0
        return math.log((target[x] + smooth) / (both * a + smooth)) - math.log((raw[x] + smooth) / (both * b + smooth))

    want = {}
    for i, t in [*data, (99, "")]:
        a, b = grams(t)
        raw = sum(ratio(x, n[0], total, 5) for x in a + b)
        bad = sum(r for x in set(a) if (r := ratio(x, d[0], d[2], 2, 4)) <= -importance.STRONG)
        want[i] = -np.logaddexp(-(raw + importance.MARGIN), -(bad + importance.MARGIN))
    rows = out.collect()
    assert len(rows) == len(want) and all(abs(r._log_weight - want[r.doc_id]) < 1e-3 * max(1, abs(want[r.doc_id])) for r in rows)
    k = round(sum(min(1.0, math.exp(3 * w)) for w in want.values()))
    least = threshold()
    assert sum(r._key >= least for r in rows) == k and least == sorted((r._key for r in rows), reverse=True)[k - 1]
    assert importance.weighed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=5)[1]() == sorted((r._key for r in rows), reverse=True)[4]


def test_kernel_by_brute_force():
    """Presence against sets of n-grams; the folded model against kernel values with the landmarks, entry by entry."""
    texts = ["Straße der Wörter", "the words of a street", "la rue des mots", "el camino", "die Wörter, der Satz!", "a street of words"] * 3
    texts = [f"{t} {i}" for i, t in enumerate(texts)]
    langs = ["de", "en", "fr", "es", "de", "en"] * 3
    x = language.presence(texts)
    for t, row in zip(texts, x, strict=True):
        low = [32 if ord(c) < 128 and not c.isalpha() else ord(c) for c in f" {t.lower()} "]
        places = set()
        for n in range(1, language.ORDER + 1):
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h * int(language.MULTIPLIERS[0]) + c + 1) % 2**64
                places.add(int(language.mix(np.array([(h + n) % 2**64], np.uint64))[0]) % language.DIMENSIONS)
        assert set(np.flatnonzero(row).tolist()) == places
    model = language.fit([(lang, np.packbits(r).tobytes()) for lang, r in zip(langs, x, strict=True)], 12, 0.1)
    sets = [set(np.flatnonzero(r).tolist()) for r in x]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    turn = sorted((langs[:i].count(lang), i) for i, lang in enumerate(langs))
    marks = [i for _, i in turn][:12]
    K = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(K)
    phi = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T)
    names = sorted(set(langs))
    weight = np.array([1 / langs.count(lang) for lang in langs])
    weight *= len(langs) / weight.sum()
    goal = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    w = np.linalg.solve((phi * weight[:, None]).T @ phi + 0.1 * np.eye(12), (phi * weight[:, None]).T @ goal)
    scores = phi @ w
    best, score = model.predict(texts)
    assert (best == scores.argmax(1)).all() and np.abs(score - np.clip((scores.max(1) + 1) / 2, 0, 1)).max() < 1e-3


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', pmod(id, 7)) AS lang")
    got = Counter(r.lang for r in language.sample(docs, 20, 5, F.lit(True)).collect())
    assert len(got) == 5 and set(got.values()) == {20}


def test_lines_by_brute_force(spark):
    """Verdict and cleaned text of op4, line by line."""
    got = {r.doc_id: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    cleaned = {r.doc_id: r.cleaned_text for r in quality_rules.clean_lines(table(spark, "documents")).collect()}
    for i, t in texts(spark).items():
        keep, lost = [], []
        for line in t.split("\n"):
            w = re.findall(WORD, line)
            marked = len(re.findall(r"[#*$%&<>]{2,}|!!+", line))
            cells = len(re.findall("[|»›·•]", line))
            plain = not re.search("[.,;:!?'\"()\\-–-…。，]", line)
            bad = bool(w) and (marked and 4 * marked >= len(w) or len(w) >= 30 and plain or cells >= 2 and len(w) <= 5 * (cells + 1) or len(w) <= 20 and quality_rules._FURNITURE.search(line.encode()))
            (lost if bad else keep).append(line)
        r = got[i]
        n = sum(len(re.findall(WORD, x)) for x in lost)
        assert cleaned[i] == "\n".join(keep) and r.cleaned_sha256 == hashlib.sha256("\n".join(keep).encode()).hexdigest()
        assert (r.n_lost_lines, r.n_lost_words, r.n_lost_chars) == (len(lost), n, sum(map(len, lost))) and r.kept == (not r.base_failed and n <= 0.4 * r.n_words)


def test_lists_of_any_size(spark):
    """The shuffled join gives what the broadcast one does; columns named like the new ones are replaced."""
    pages = table(spark, "pages").select("url").withColumn("fetched", F.lit("2024-01-20").cast("timestamp_ntz")).withColumns({c: F.lit("old") for c in ("host", "_u", "_url", "_n", "c0")})
    entries = url_filters.drawn_entries(pages)
    a, b = (url_filters.screened(pages, entries, few=n) for n in (10**6, 0))
    assert a.columns == [c for c in pages.columns if c != "host"] + ["host", "n_active", "matched"]
    assert Counter(a.collect()) == Counter(b.collect()) and a.where("n_active > 0").count() > 0


@pytest.mark.parametrize("block_bytes", [1, 60, 1 << 20])
def test_contamination_by_blocks_against_brute_force(spark, block_bytes):
    """One item a block, several, all in one: the same, and what comparing every window with every place says."""
    rng = random.Random(5)
    words = [f"W{i}" for i in range(12)] + ["é", "漢字"]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", draw(n)) for k, n in enumerate([1, 2, 3, 4, 9, 10, 11, 30])]
    items += [("again", items[6][1]), (None, items[5][1].lower()), ("i7", "W1, w2"), ("none", None), ("empty", "")]
    texts = [draw(n) for n in (0, 1, 5, 40)] + [f"{draw(7)} {t}. {draw(3)}" for _, t in items if t] + [None, "", items[7][1]] + [items[6][1]] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for d, text in enumerate(texts):
        w, hits, names = cut(text), set(), set()
        for name, t in items:
            v = cut(t)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hits.update(range(p, p + n))
                        names |= {name} - {None}
        want[d] = (len(w), sorted(hits), sorted(names))
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string").coalesce(1), block_bytes=block_bytes)
    got = out.select("doc_id", "_n_words", "_hits", "_items").collect()
    assert len(got) == len(texts) and {r.doc_id: (r._n_words, r._hits, r._items) for r in got} == want
    assert sum(bool(h) for _, h, _ in want.values()) > 25


def test_few_edges_take_few_stages(spark):
    """Components of few edges are one task's work: rounds of shuffles fill the driver, however small they are."""
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = [(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in zip(order, order[1:], strict=False) if a % 50 and b % 50]
    frame = spark.createDataFrame([*edges, (None, b"1"), (b"7", b"7")], "a binary, b binary")
    before = spark._jsc.sc().dagScheduler().nextStageId()
    got = {bytes(r.node): bytes(r.component) for r in shared.components(frame).collect()}
    assert spark._jsc.sc().dagScheduler().nextStageId() - before < 30
    up = {x: x for e in edges for x in e}
    for _ in range(n):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "ONE_TASK", most)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_the_drivers_garbage_is_collected(spark, monkeypatch):
    """A JVM object that nothing refers to is gone once a frame is saved and the heap is past the share, and not before."""
    jvm, now = spark._jvm, shared.time.monotonic() if hasattr(shared, "time") else 0.0

    def alive(share, collected):
        monkeypatch.setattr(shared, "HEAP_SHARE", share, raising=False)
        monkeypatch.setattr(shared, "_collected", collected, raising=False)
        ref = jvm.java.lang.ref.WeakReference(spark.sparkContext._gateway.new_array(jvm.byte, 1 << 20))
        assert shared.saved(spark.range(3)).count() == 3
        return ref.get() is not None

    assert not alive(0.0, now - 60)
    assert alive(0.0, now + 3600) and alive(1.0, now - 60)


def test_the_driver_holds_filters_and_counts_small(spark):
    """A filter is sent at a bit a place and answers as before; counts are summed up without a copy of them all at once."""
    h = np.arange(1, 5_000, dtype=np.int64) * 7_919
    held = bloom.bloom_of(spark.createDataFrame([(int(x),) for x in h] + [(None,)], "h long"))
    raw = pickle.dumps(held)
    assert len(raw) < bloom.BITS // 8 + 1_000 and pickle.loads(raw).may_hold(h.view(np.uint64)).all()
    assert held.any() and held.may_hold(-h.view(np.uint64)).mean() < 0.01 and not bloom.bloom_of(spark.range(0)).any()
    docs, labels = (table(spark, name) for name in ("documents", "labels"))
    tracemalloc.start()
    try:
        importance.train(docs, labels, 20_000)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    """Filters keep them out of the shuffles; where the filters let everything pass, the joins give the same rows."""
    draw = random.Random(4)
    text = lambda: " ".join(f"{draw.getrandbits(64):x}" for _ in range(2_400))
    base = text()
    data = [(1, base), (1, base), (2, base), (None, base), (3, base + " tail"), (4, None), (4, None), *((k, text()) for k in range(10, 200))]
    docs = shared.saved(spark.createDataFrame(data, "doc_id long, text string"))
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    last = max(s.stageId() for s in stages())
    kept = Counter(jaccard_join.one_of_each(docs).collect())
    assert kept == Counter([(1, base), *data[5:]])
    moved = sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)
    assert moved < sum(len(t or "") for _, t in data) / 2
    monkeypatch.setattr(bloom.Bloom, "among", lambda self, hashes: F.lit(True))
    assert Counter(jaccard_join.one_of_each(docs).collect()) == kept
