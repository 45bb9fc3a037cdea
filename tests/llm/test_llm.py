"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, kept string"


def docs(spark, texts, sources=("a",), langs=("en",)):
    """Documents with columns whose names clash with the results'."""
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], 0, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", "   \n", "a", "A b\tc", "a bc", "one two three four five six", "one two three four five six ", "é ü ß ½ ²", "a\x0b\x0cb", "x" * 5000, "w " * 3000, "a", "don't <|endoftext|> it's", " lead", "▁x ▁", "日本語 テキスト 😀"]


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    from fraudlens.llm.exact_dedup import exact_dedup

    digest = {"digest": lambda c: F.length(c).cast("string")} if weak else {}
    got = collect(exact_dedup(docs(spark, ODD), **digest))
    norm = [(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for t in ODD]
    for i, t in enumerate(norm):
        same = [j for j, x in enumerate(norm) if x == t]
        keep = min(same, key=lambda j: (-len(ODD[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(same), keep == i)
        if not weak:
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup(docs(spark, ODD).limit(0)).count() == 0


def test_drop_exact_copies_keeps_columns(spark):
    from fraudlens.llm.exact_dedup import drop_exact_copies

    out = drop_exact_copies(docs(spark, ["a b", "ab", "c"]))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(r.doc_id for r in out.collect()) == [0, 2]


# --- mixing


def test_mix_meets_targets(spark):
    from fraudlens.llm.mixing import plan_mix

    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None]
    got = plan_mix(docs(spark, texts, ("a", "b", "c", "d", None))).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.first_position is None) == (r.taken == 0)
    assert len(by) == 5 and sum(t for _, t in by) == pytest.approx(sum(r.size for r in got))
    for (size, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= 1 and target <= 3 * size + 1e-6
    again = plan_mix(docs(spark, texts, ("a", "b", "c", "d", None)).repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "taken", "first_position").collect())) == sorted((r.doc_id, r.taken, r.first_position) for r in got)


def test_schedule_inversion(spark):
    from fraudlens.llm.mixing import SCHEDULES, integral, invert

    for knots in (*SCHEDULES, ((0.0, 0.0), (0.25, 4.0), (1.0, 1.0))):
        share = [i / 20 for i in range(21)]
        got = [r.t for r in spark.createDataFrame([(s,) for s in share], "s double").select(invert(knots, F.col("s")).alias("t")).collect()]
        for s, t in zip(share, got):
            done = sum(max(0.0, min(t, b) - a) * (wa + (wa + (wb - wa) * (min(t, b) - a) / (b - a))) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
            assert done == pytest.approx(s * integral(knots), abs=1e-9)


def test_training_order_is_sorted_and_whole(spark):
    from fraudlens.llm.mixing import training_order

    out = training_order(docs(spark, ["w " * n for n in range(1, 40)] + ["", None], ("a", "b")))
    assert "text" in out.columns and 0 < out.count() < 120 and training_order(docs(spark, ["", None])).count() == 0


# --- sharding


def test_sharding_by_bytes(spark):
    from fraudlens.llm.sharding import place_slots, rebalance, shard_by_bytes, sized, slot_sizes

    rng = random.Random(2)
    texts = ["é" * rng.randrange(1, 400) for _ in range(500)] + [None, "", "same", "same"]
    rows = shard_by_bytes(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    loads, places = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 801
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first = place_slots(slot_sizes(sized(docs(spark, texts))), 8)
    old, new = collect(first, "v_slot"), collect(rebalance(first, 9), "v_slot")
    assert old.keys() == new.keys() and {r.version for r in new.values()} == {2}
    moved = [s for s in old if new[s].shard != old[s].shard]
    assert moved and all(new[s].shard == 8 for s in moved)
    assert shard_by_bytes(docs(spark, texts).limit(0)).count() == 0


# --- tokens


def test_tokens_through_orc(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fraudlens.llm.token_orc import tokens_through_orc

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + ["a\x1cb \x1d c", "word " * 2000]
    got, start = collect(tokens_through_orc(docs(spark, texts))), 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens_through_orc(docs(spark, texts).limit(0)).count() == 0


def test_word_table_begins_anew(spark):
    import pyarrow as pa

    from fraudlens.llm.token_orc import WordTable, default_tokenizer

    small, large = WordTable(default_tokenizer(), 50), WordTable(default_tokenizer())
    for part in (["alpha beta, gamma " * 3, None or "", "delta's " * 5], [" ".join(f"w{i}x" for i in range(200))], ["alpha zeta"]):
        a, b = small.encode(pa.array(part, pa.string())), large.encode(pa.array(part, pa.string()))
        assert all((x == y).all() for x, y in zip(a, b))


def test_texts_are_cut_as_the_tokenizer_does():
    """Bytes are cut in slices of any size: contractions, numbers, two-byte letters and odd words stay whole."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from fraudlens.llm import token_orc

    t, table, rng = Tokenizer.from_file(token_orc.default_tokenizer()), token_orc.WordTable(token_orc.default_tokenizer(), 500), random.Random(5)
    parts = "'s 'T 're 'VE 'm 'll 'D ' '' 'l the ThE é É Ÿ ß ẞ İ ı ſ Σ ΑΣ J\u030c e\u0301 1 23 ½ ² ٣ . ... , — “ 日本 😀 ﬁ < <| |> <|endoftext|> <|ENDOFTEXT|>".split()
    parts += [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\x00", "\x7f", *map(chr, range(0x180))]
    for cut in (1, 60, token_orc.BYTES_A_CUT):
        texts = ["", "it'"] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)] + ["", "é"]
        assert sum(n for _, n in token_orc.slices(pa.array(texts), len(texts), cut)) == len(texts)
        before, token_orc.BYTES_A_CUT = token_orc.BYTES_A_CUT, cut
        try:
            ids, ends = table.encode(pa.array(["left out", *texts]).slice(1))
        finally:
            token_orc.BYTES_A_CUT = before
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [len(x) for x in table.encode(pa.array([], pa.string()))] == [0, 1]


def test_encoding_is_bounded():
    """A task remembers no more names than it may, and long texts leave it in batches of bounded size."""
    import pyarrow as pa

    from fraudlens.llm import token_orc

    path, most = token_orc.default_tokenizer(), 1000
    table = token_orc.WordTable(path, most)
    for k in range(30):
        table.encode(pa.array([" ".join(f"{a}{b}{chr(97 + k % 26)}." for a in "abcdefghij" for b in "klmnopqrst")]))
        assert sum(len(x) for x in vars(table).values() if isinstance(x, dict)) <= most
    texts = ["word, " * 100_000] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([0] * 40, pa.int32()), pa.array(texts)], names=["doc_id", "tie", "part", "text"])
    sizes = [x.num_rows for x in token_orc.encode_partition(path, 2, most)([batch])]
    assert sum(sizes) == 40 and max(sizes) <= token_orc.BYTES_A_BATCH // len(texts[0])


def test_long_text_is_cut_at_blanks():
    """What numpy holds while it cuts does not grow with the length of one text."""
    import tracemalloc

    import pyarrow as pa

    from fraudlens.llm import token_orc

    table = token_orc.WordTable(token_orc.default_tokenizer())
    texts = pa.array(["Many, words' \n" * 2_000_000])  # 28 MB
    assert [x[0].as_py() for x in token_orc.at_blanks(pa.array(["é b  ccc d"]), 3)] == ["é b ", " ccc ", "d"]
    table.encode(pa.array(["warm, up"]))
    tracemalloc.start()
    try:
        ids, ends = table.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == ends[-1] == 8_000_000 and peak < 3 * texts.nbytes


def test_sentencepiece(spark):
    import sentencepiece

    from fraudlens.llm.sentencepiece_ids import decode_ids, default_model, encode_ids, round_trip

    p = sentencepiece.SentencePieceProcessor(model_file=default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = [*ODD, "a  b", " a ", "\x00a", "a▁b", "a\n\n b"]
    for most in (400_000, 3):
        got = collect(round_trip(docs(spark, texts), most=most))
        for i, text in enumerate(texts):
            ids = p.encode(text or "")
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(p.decode(ids) if ids else ""))
    back = collect(decode_ids(encode_ids(docs(spark, texts))))
    assert all(back[i].text == (p.decode(p.encode(x)) if x else "") for i, x in enumerate(texts))


def test_chunk_table_begins_anew_between_overlapping_batches():
    from fraudlens.llm.sentencepiece_ids import ChunkTable, chunk_table, default_model

    table = ChunkTable(default_model(), 40)
    words = [f"w{i}x" for i in range(200)]
    most = 40
    for first, last in ((0, 10), (5, 50), (45, 60), (0, 200), (190, 200), (195, 235)):
        text = " ".join((words + words)[first:last])
        (split,) = table.encode([text])
        assert [i for x in split for i in table.ids[x]] == table.model.encode(text) and set(split) <= table.told.keys()
        most = max(most, len(set(split)))
        assert len(table.ids) == len(table.told) <= most
    assert chunk_table(default_model(), 3).most == 3 and chunk_table(default_model(), 4).most == 4


# --- near dedup


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components(spark, seed):
    from fraudlens.llm.near_dedup import near_components

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "a b", "A  b", "a b c d e"]
    for _ in range(12):  # chains of edits: neighbours are linked, ends are not
        t = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(8):
            texts.append(" ".join(t))
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
    got = collect(near_components(docs(spark, texts), words=4))
    sets, at = [shingle_set(t, 4) for t in texts], list(range(len(texts)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                at[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def test_near_components_of_nothing(spark):
    from fraudlens.llm.near_dedup import keep_one_of_each, near_components

    assert near_components(docs(spark, ["a"]).limit(0)).count() == 0
    assert keep_one_of_each(docs(spark, [None, "", "a", "a"])).count() == 3


# --- languages


def test_language_id(spark):
    from fraudlens.llm.langid import identify

    rng = random.Random(4)
    words = {"en": "the of and to in that is was".split(), "xx": "ñandú über çela þorn øre".split()}
    texts, langs = [], []
    for i in range(160):
        lang = ("en", "xx")[i % 2]
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(30)))
        langs.append(lang)
    texts[0], texts[1] = None, "12 34 !!"
    got = collect(identify(docs(spark, texts, langs=("en", "xx"))))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert got[0].lang_pred == got[1].lang_pred == "und"
    assert sum(got[i].lang_pred == langs[i] for i in range(2, 160)) >= 156
    assert {r.lang_pred for r in identify(docs(spark, texts, langs=(None,))).collect()} == {"und"}
    assert identify(docs(spark, texts).limit(0)).count() == 0


# --- URLs


def test_url_parts_rules_and_model(spark):
    from fraudlens.llm.url_filter import judge_urls

    urls = [None, "no scheme", "HTTP://A.Example.NET/en/x?q=/de/", "http://example.net", "http://b.net/de/1#x", "https://www.example.com/de/9", "http://x.org/fr/1", "a://b://c/d", "http://net.evil.io/fr/2"]
    urls += [f"http://s{i}.example.net/en/{i}" for i in range(40)] + [f"http://bad{i}.net/de/{i}" for i in range(40)] + [f"http://q{i}.io/de/{i}" for i in range(5)] + [f"http://q{i}.io/en/{i}" for i in range(5)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = collect(judge_urls(pages), "page_id")
    want = {0: ("", "", None), 1: ("", "", None), 2: ("a.example.net", "/en/x", "example.net/en/"), 3: ("example.net", "", None), 4: ("b.net", "/de/1", "net/"), 5: ("www.example.com", "/de/9", "example.com/de/"), 6: ("x.org", "/fr/1", "org/fr/"), 7: ("b:", "//c/d", None), 8: ("net.evil.io", "/fr/2", None)}
    assert {i: (got[i].host, got[i].path, got[i].rule) for i in want} == want
    assert [got[i].verdict for i in (2, 4, 5, 6)] == ["allow", "block", "block", "allow"]
    import math
    import re

    from fraudlens.llm.url_filter import SYMBOLS

    clean = lambda u: "^^" + re.sub("[^a-z0/.\\-_?=&%#:~+@]", "*", re.sub("[0-9]", "0", re.sub("^[a-z][a-z0-9+.-]*://", "", (u or "").lower()))) + "$"
    texts = [clean(u) for u in urls]
    labelled = [(t, got[i].verdict) for i, t in enumerate(texts) if got[i].rule and zlib.crc32(t.encode()) % 4]

    def model(verdict):
        counts = {}
        for t, v in labelled:
            for k in range(2, len(t)):
                for n in (1, 2, 3):
                    g = t[k - n + 1 : k + 1]
                    counts.setdefault(g[:-1], {}).setdefault(g[-1], 0)
                    counts[g[:-1]][g[-1]] += v == verdict
        return counts

    both = {v: model(v) for v in ("allow", "block")}

    def probability(counts, context, c):
        if not context:
            seen = counts[""]
            return (seen.get(c, 0) + 1) / (sum(seen.values()) + len(SYMBOLS) + 1)
        less = probability(counts, context[1:], c)
        seen = counts.get(context, {})
        n, kinds = sum(seen.values()), sum(x > 0 for x in seen.values())
        return less if not n else (seen.get(c, 0) + kinds * less) / (n + kinds)

    for i, t in enumerate(texts):
        ratio = [math.log(probability(both["allow"], t[k - 2 : k], t[k]) / probability(both["block"], t[k - 2 : k], t[k])) for k in range(2, len(t))]
        assert got[i].score == pytest.approx(sum(ratio) / len(ratio), abs=1e-9)
    free = [got[i] for i in range(89, 99)]
    least = max((r.score for r in free if r.verdict == "block"), default=-99)
    assert least < min((r.score for r in free if r.verdict == "allow"), default=99)
    assert judge_urls(pages.limit(0)).count() == 0 and {r.verdict for r in judge_urls(pages.limit(2)).collect()} == {"allow"}


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="sidebar"><p>Side text, long enough to count.</p></div><div class="cookie-notice">We use cookies, as all do.</div>
<article><h1>Head &amp; tail</h1><p>First   paragraph,
with <b>bold</b>&nbsp;text &#233; &lt;x&gt;.<p>Second one<br>here, unclosed.<div class="ad">Buy, buy, buy now.</div><ul><li>one<li>two</ul>
<form><p>Your name</p></form><div id="comments"><p>Great post, really, thanks a lot.</p></div></article>
<footer>&copy; foot</footer><script>var t = "</p>"; if (a < b) {}</script></body></html>"""


def test_main_text(spark):
    from fraudlens.llm.html_extract import extract_main_text

    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "plain, text only.", "x")], "page_id long, url string, html string, text string")
    got = collect(extract_main_text(pages), "page_id")
    assert got[1].text == "Head & tail\nFirst paragraph, with bold text é <x>.\nSecond one here, unclosed.\none\ntwo" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None) and got[3].text == "" and got[4].text == "plain, text only."
    assert extract_main_text(pages.limit(0)).count() == 0


# --- vectors


def test_ann_recall_and_ranks(spark):
    from fraudlens.llm.ann import search

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:720] = x[700]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [1.0] * 3), (None, [1.0] * 16)]
    vectors = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {}
    for r in search(vectors, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == set(range(0, 1500, 50))
    y = x.astype(float)
    n = np.sqrt((y * y).sum(1))
    hits = 0
    for q, found in got.items():
        s = (y * y[q]).sum(1) / n / n[q]
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 and v != q for _, v, c in found)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(1500), -s))[:5]) & {v for _, v, _ in found})
    assert hits / 150 >= 0.9
    assert [v for _, v, _ in sorted(got[700])] == [701, 702, 703, 704, 705]
    assert search(vectors.limit(0), F.lit(True)).count() == 0
    assert search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.lit(True)).count() == 6


# --- pipeline


#: (doc_id, text, source): null ids, ids of several rows and of several texts, whole copies.
REPEATED = [(None, "a b"), (None, "ab"), (None, "other text here"), (7, "seven eight"), (7, "seven eight"), (7, "seveneight"), (7, "unlike"), (8, "unlike"), (9, "ab")]


def repeated(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], SCHEMA).repartition(3)


def test_drop_exact_copies_with_null_and_repeated_ids(spark):
    from fraudlens.llm.exact_dedup import drop_exact_copies

    out = drop_exact_copies(repeated(spark, [(i, t, "a") for i, t in REPEATED])).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("7", "seven eight"), ("7", "unlike"), ("None", "a b"), ("None", "other text here")]


def test_keep_one_of_each_with_null_and_repeated_ids(spark):
    from fraudlens.llm.near_dedup import keep_one_of_each

    long, far = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (None, long + " end"), (3, long), (3, far), (3, far), (2, far + " end"), (None, None), (None, None), (None, "lone text")]
    out = keep_one_of_each(repeated(spark, [(i, t, "a") for i, t in rows])).collect()
    want = [("2", far + " end"), ("3", long), ("None", "None"), ("None", "None"), ("None", "lone text")]
    assert out[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")} and sorted((str(r.doc_id), str(r.text)) for r in out) == sorted(want)


def test_training_order_with_null_and_repeated_ids(spark):
    from collections import Counter

    from fraudlens.llm.mixing import plan_mix, training_order

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, i]), f"t{i} " * rng.randrange(1, 30), rng.choice(["a", "b", None])) for i in range(120)]
    frame = repeated(spark, rows)
    out = Counter(r.text for r in training_order(frame).collect())
    plan = plan_mix(frame, carry=True).select("_doc.text", "size", "taken").collect()
    assert len(plan) == 120 and all(out[r.text] == int(r.taken / r.size + 0.5) for r in plan)
    assert any(out[t] for i, t, _ in rows if i is None) and max(out.values()) <= 3
    again = [(r.doc_id, r.text) for r in training_order(frame.repartition(5)).collect()]
    assert again == [(r.doc_id, r.text) for r in training_order(frame).collect()]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    base = [text(60) for _ in range(30)]
    near = [b + " end" for b in base[:5]]
    texts = base + base[:4] + near + ["123 !!", None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts, at = [], frame
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "")
        counts.append(at.count())
        if len(counts) < 5:
            assert at.columns == frame.columns
    assert counts[:3] == [39, 35, 30] and counts[3] == counts[4] > 0
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]
