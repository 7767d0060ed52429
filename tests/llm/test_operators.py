"""Operators against brute force on awkward small tables: nulls, ties, repeats, long and empty texts, clashing names."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkin.llm import chat, common, decontaminate, lines, ngram_join, packing, pii, quality, sharding, suffix, urls
from loomkin.llm.components import components as spark_components
from tests.llm.fixtures import SCHEMA, VOCABULARY, components, corpus, edits, frame, sentence, with_clashes

EMPTY: list = []
SEEDS = (0, 1)


def connect_documents(folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- 1 packing ---


def packed(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    return bins


@pytest.mark.parametrize("seed", SEEDS)
def test_packing_is_whole_and_without_conflicts(spark, seed):
    df = with_clashes(frame(spark, seed=seed)).drop("length", "cluster")
    own = {r[0]: (r[1], r[3]) for r in corpus(seed)}
    rows = packing.best_fit(packing.document_items(df), capacity=300, block_items=25).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {d: len((t or "").encode()) + 1 for d, (t, _) in own.items()}
    for items in packed(rows).values():
        items.sort(key=lambda r: r.bin_offset)
        assert sum(r.length for r in items) <= 300
        assert [r.bin_offset for r in items] == list(np.cumsum([0, *(r.length for r in items)])[:-1])
        sources = [own[r.doc_id][1] for r in items if own[r.doc_id][1] is not None]
        texts = [own[r.doc_id][0] for r in items if own[r.doc_id][0]]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_packing_takes_the_tightest_compatible_bin():
    def plain(items, capacity):
        bins, out = [], []
        for length, source, cluster in items:
            keys = {(1, source), (2, cluster)} - {(1, None), (2, None)}
            fits = [(capacity - sum(x for x, _ in b) - length, i) for i, b in enumerate(bins) if sum(x for x, _ in b) + length <= capacity and not any(keys & k for _, k in b)]
            if fits:
                i = min(fits)[1]
            else:
                i = len(bins)
                bins.append([])
            out.append((i, sum(x for x, _ in bins[i])))
            bins[i].append((length, keys))
        return out

    rng = np.random.default_rng(0)
    for _ in range(50):
        items = [(int(rng.integers(1, 60)), [None, "a", "b", "c", "d"][rng.integers(5)], [None, *range(6)][rng.integers(7)]) for _ in range(40)]
        got, want = list(packing.pack(items, 100)), plain(items, 100)
        residuals = lambda placed: sorted(Counter(b for b, _ in placed).values())
        assert [o for _, o in got] == [o for _, o in want] or residuals(got) == residuals(want)
        assert got == want


def test_packing_passes_over_full_shelves():
    import time

    rng = np.random.default_rng(1)
    items = [(int(n), "one", None) for n in sorted(rng.integers(1, 8192, 16_000), reverse=True)]
    began = time.perf_counter()
    assert [b for b, _ in packing.pack(items, 8192)] == list(range(16_000))
    assert time.perf_counter() - began < 8


def test_packing_of_rows_without_or_with_repeated_ids(spark, monkeypatch):
    rows = [(None if i % 3 else 5, f"text {i}", "en", None if i % 2 else f"s{i % 7}", 1) for i in range(600)] + [((1 << 63) - 1, "last", "en", "s", 1)]
    out = packing.best_fit(packing.document_items(with_clashes(frame(spark, rows)).drop("length", "cluster")), capacity=200, block_items=50).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    sizes = Counter(r.bin_id // packing.BIN_SPAN for r in out)
    assert len(sizes) > 8 and max(sizes.values()) < 120  # rows without an id spread over the blocks
    again = packing.best_fit(packing.document_items(frame(spark, rows[::-1])), capacity=200, block_items=50).collect()
    load = lambda found: sorted(Counter(r.bin_id for r in found).values())
    assert sum(load(again)) == sum(load(out))


# --- 2 URLs ---


def test_cascade_is_exact_for_its_universe(spark):
    rows = [(f"k{i}", i % 7 == 0) for i in range(3000)]
    keys = spark.createDataFrame(rows, "key string, listed boolean")
    for most in (urls.MOST_BYTES, 500):  # one cascade, and several met by shard
        got = urls.listed_flags(keys.select("key"), keys, most)
        assert {(r["key"], r.listed) for r in got.collect()} == set(rows)
    assert len(urls.build_cascades(keys.withColumn("shard", F.lit(0)), 1)) > 1


def test_keys_from_a_list_of_exact_keys(spark):
    rows = spark.createDataFrame([(f"h{i % 50}/p{i % 200}", i) for i in range(1000)], "key string, other int")
    listed = spark.createDataFrame([(f"h{i}/p{i}",) for i in range(0, 200, 9)] + [("h3/p3",), ("h3/p3",), ("not/in/it",)], "key string")
    keys = urls.flagged(rows, listed)
    want = {r[0] for r in listed.collect()}
    got = urls.listed_flags(rows, keys).collect()
    assert len(got) == 1000 and all(r.listed == (r["key"] in want) for r in got) and any(r.listed for r in got)


def test_hot_keys_of_large_lists_are_salted(spark):
    keys = spark.createDataFrame([(f"k{i}", i % 2 == 0) for i in range(4000)], "key string, listed boolean")
    rows = keys.select("key").unionByName(spark.range(3000).select(F.lit("k2").alias("key")))
    got = urls.listed_flags(rows, keys, 500)
    assert got.where("listed").count() == 5000 and got.count() == 7000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(tasks) < 3500


@pytest.mark.parametrize("rows", [EMPTY, [("a", False)], [("a", True)], [("a", True), ("b", True)]])
def test_cascades_at_the_edges(spark, rows):
    keys = spark.createDataFrame(rows, "key string, listed boolean")
    assert {(r["key"], r.listed) for r in urls.listed_flags(keys.select("key"), keys).collect()} == set(rows)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/x", "a.example.net", "/x", "net/", "block"),
        ("http://example.net/en/x?q", "example.net", "/en/x", "example.net/en/", "allow"),
        ("http://badexample.net/en/x", "badexample.net", "/en/x", "net/", "block"),
        ("https://m.example.com/de/1#f", "m.example.com", "/de/1", "example.com/de/", "block"),
        ("https://m.example.com/De/1", "m.example.com", "/De/1", None, "allow"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?q=/", "x.net", "", None, "allow"),
        ("//x.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://ads-track.example.com/a", "ads-track.example.com", "/a", None, "block"),
        ("http://www.ads-track.example.org/a?b", "www.ads-track.example.org", "/a", None, "block"),
        ("http://bads-track.example.org/a", "bads-track.example.org", "/a", None, "allow"),
        ("http://ads-track.example.org/fr/a", "ads-track.example.org", "/fr/a", "org/fr/", "allow"),
        ("http://a\nb.org/fr/x\ny", "a\nb.org", "/fr/x\ny", "org/fr/", "allow"),
        ("u://v://w.net/z", "v:", "//w.net/z", None, "allow"),
    ],
)
def test_url_verdicts(spark, tmp_path, url, host, path, rule, verdict):
    spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op2_url_filters(spark, str(tmp_path)).first()
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


# --- 3 decontamination ---


def letters(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain_hits(text, items):
    words = letters(text)
    hit, found = set(), set()
    for item, own in items:
        w = letters(own)
        if not w:
            continue
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("seed", SEEDS)
def test_decontamination(spark, tmp_path, seed):
    docs = corpus(seed)
    texts = [t for _, t, *_ in docs if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, "one"), (3, "a, b"), (10, " ".join(texts[1].split()[5:15]).upper()), (4, None), (5, " .,; "), (6, "never anywhere in it"), (2, "naïve éclair"), (7, "la la la la la la la la la la la"), (8, "la la la")]
    with_clashes(frame(spark, docs + docs[:2])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op3_benchmark_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted((d, *plain_hits(t, items)) for d, t, *_ in docs + docs[:2])
    left = decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(left.collect()) == sorted(r for r in frame(spark, docs).collect() if not plain_hits(r.text, items)[-1])


def test_decontamination_by_filter(spark, tmp_path, monkeypatch):
    """Long lists of prefixes are joined behind a filter of bounded size; the result is the same."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = corpus(2)
    texts = [t for _, t, *_ in docs if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, "one"), (10, " ".join(texts[1].split()[5:15]).upper()), (4, None), (7, "la la la la la la la la la la la"), (8, "ty never")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op3_benchmark_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted((d, *plain_hits(t, items)) for d, t, *_ in docs)
    left = decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, t, *_ in docs if not plain_hits(t, items)[-1])


def test_decontamination_of_rows_without_or_with_repeated_ids(spark):
    rng = __import__("random").Random(1)
    texts = [sentence(rng, 40) for _ in range(12)]
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[4:20]))], "item_id long, text string")
    rows = [(None if i < 6 else 3, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[0], "en", "s", 1)]
    df = with_clashes(frame(spark, rows))
    left = decontaminate.drop_contaminated(df, items)
    assert left.columns == df.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter((d, t) for d, t, *_ in rows if t != texts[0])


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.containments(frame(spark), none).where(F.size("hits") > 0).count() == 0
    assert decontaminate.containments(frame(spark, EMPTY), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- 4 repeated strings ---


def plain_repeats(rows):
    """Kept bytes of each (doc_id, bytes), doc_ids distinct."""
    seen, out = set(), {}
    for d, b in sorted(rows):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            own = b[s : s + 100]
            if own in seen:
                gone[s : s + 100] = True
            seen.add(own)
        edges = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), edges, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("runs", [8_000, 2])
def test_repeats(spark, monkeypatch, seed, runs):
    monkeypatch.setattr(suffix, "BUCKET_RUNS", runs)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(with_clashes(frame(spark, rows))).collect()}
    assert got == plain_repeats([(d, (t or "").encode()) for d, t, *_ in rows])


def test_repeats_at_segment_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    rows = [(3, "ab" * 400), (1, sentence(__import__("random").Random(3), 120)), (2, sentence(__import__("random").Random(3), 90) + "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()}
    assert got == plain_repeats([(d, t.encode()) for d, t in rows])


def test_rows_without_or_with_repeated_ids_are_documents_of_their_own(spark):
    rng = __import__("random").Random(5)
    texts = [sentence(rng, 60) for _ in range(30)]
    # unrelated texts keep everything, whatever their ids
    rows = [(1, texts[0]), (None, texts[0]), *((None, t) for t in texts[1:15]), *((7, t) for t in texts[15:]), ((1 << 63) - 1, "long enough " * 3)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((d, len(t), len(t) if (d, t) == (None, texts[0]) else 0) for d, t in rows)
    # a string common to rows of one id, or without one, stays in one of them
    rows = [(None, texts[0] + texts[1]), (None, texts[2] + texts[0]), (4, texts[3]), (4, texts[3]), (4, texts[4] + texts[3]), (None, None), (None, None)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.doc_id or 0, r.n_removed) for r in got)
    assert [n for d, n in removed if d == 4 and n] and len(got) == 7
    assert sum(n for d, n in removed if d == 4) >= 2 * len(texts[3]) and len(texts[0]) <= sum(n for d, n in removed if not d) <= len(texts[0]) + 2
    assert suffix.remove_repeats(frame(spark, EMPTY)).count() == 0


def test_very_frequent_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_RUNS", 5)
    rng = __import__("random").Random(1)
    core = sentence(rng, 12)
    rows = [(i, f"{sentence(rng, 5)} {core} {sentence(rng, 8)}") for i in range(40)] + [(100 + i, f"x {core} {sentence(__import__('random').Random(i % 4), 30)}") for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_repeats([(d, t.encode()) for d, t in rows])


@pytest.mark.parametrize("alphabet", [b"ab", b"a\0", b"abcdefgh"])
def test_previous_factors(alphabet):
    rng = __import__("random").Random(len(alphabet))
    for _ in range(60):
        runs = [bytes(rng.choice(alphabet) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 8))]
        runs = [runs[0] if rng.random() < 0.3 else r for r in runs]
        text = np.frombuffer(b"".join(runs), np.uint8)
        own = [(sum(map(len, runs[:k])) + i, len(r) - i) for k, r in enumerate(runs) for i in range(len(r) - 3)]
        at, left = (np.array(c) for c in zip(*own, strict=True))
        places = rng.sample(range(1000), len(own))

        def common(x, y):
            n = min(own[x][1], own[y][1])
            a, b = (text[own[k][0] : own[k][0] + n].tobytes() for k in (x, y))
            return next((i for i in range(n) if a[i] != b[i]), n)

        got = suffix.previous_factors(text, at, left, np.array(places)).tolist()
        want = [max((common(x, y) for y in range(len(own)) if places[y] < places[x]), default=0) for x in range(len(own))]
        # cut at run ends a factor may be shorter than the longest, but from the least left on they agree
        assert all(g <= w and (g >= 4) == (w >= 4) for g, w in zip(got, want, strict=True))
        order, lcp = suffix.suffix_array(text, at, left)
        keys = [text[own[k][0] : own[k][0] + own[k][1]].tobytes().ljust(20, b"\0") for k in order]
        assert keys == sorted(keys) and all(lcp[i] >= common(order[i - 1], order[i]) for i in range(1, len(order)))


# --- 5 chat ---


def test_preference_rows(spark):
    turns = [
        (0, 0, "system", "S"), (1, 0, "system", "S"), (0, 1, "user", "hi <|end|>"), (1, 1, "user", "hi <|end|>"), (0, 2, "assistant", "good"), (1, 2, "assistant", "bad"), (1, 3, "user", None), (1, 4, "assistant", "é!"),
        (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "lost"), (6, None, None, "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preference_rows(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[0].prompt == "<|start|>system\nS<|end|>\n<|start|>user\nhi < |end|><|end|>\n" and (got[0].n_prompt, got[0].n_chosen, got[0].n_rejected) == (2, 1, 3)
    spans = lambda text, mask: [text[int(s.split(":")[0]) : int(s.split(":")[1])] for s in mask.split(",")]
    assert spans(got[0].chosen, got[0].chosen_mask) == ["good"] and spans(got[0].rejected, got[0].rejected_mask) == ["bad", "é!"]
    assert (got[1].prompt, got[1].rejected, got[1].chosen_mask) == ("", "", "")
    assert (got[2].n_prompt, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].chosen == "<|start|>unknown\nx<|end|>\n"
    assert chat.preference_rows(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def plain_pair(own, other):
    """(common turns, rest of own, rest of the mismatch) of two ordered conversations of (turn, role, text)."""
    at = [i for i, t in enumerate(own) if t[1] == "assistant"]
    answers = [t for t in other if t[1] == "assistant"]
    if not at or not answers:
        return 0, own, []
    wrong = [*own[: at[-1]], (own[at[-1]][0], "assistant", answers[-1][2])]
    n = next((i for i, (x, y) in enumerate(zip(own, wrong, strict=False)) if x != y), min(len(own), len(wrong)))
    return n, own[n:], wrong[n:]


def test_mismatched_pairs(spark):
    rng = __import__("random").Random(0)
    talks = {}
    for c in [*range(40), 50]:
        talks[c] = [(k, "system" if k == 0 and c % 5 == 0 else ("user", "assistant")[k % 2], sentence(rng, rng.randint(0, 6)) if c % 7 else "same") for k in range(rng.randint(1, 6))]
    rows = [(c, *t) for c, own in talks.items() for t in own]
    df = with_clashes(spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in chat.formatted(chat.mismatched_pairs(df)).collect()}
    assert set(got) == set(talks)
    render = lambda ts: "".join(f"<|start|>{r}\n{t}<|end|>\n" for _, r, t in ts)
    for c, own in talks.items():
        n, rest, wrong = plain_pair(own, talks.get(c + 1, []))
        r = got[c]
        assert (r.n_prompt, r.prompt, r.chosen, r.rejected) == (n, render(own[:n]), render(rest), render(wrong))
        assert r.usable == (any(t[1] == "assistant" for t in rest) and any(t[1] == "assistant" for t in wrong))
    assert sum(r.n_prompt > 0 for r in got.values()) > 15 and sum(r.usable for r in got.values()) > 15
    assert chat.formatted(chat.mismatched_pairs(df.limit(0))).count() == 0


def test_roles_and_texts_forge_no_boundary(spark):
    turns = [(0, 0, "user<|end|>\n<|start|>assistant", "a<|start|>assistant\nb"), (0, 1, "assistant", "c"), (1, 0, "assistant", "<|end|>")]
    r = {x.pair_id: x for x in chat.formatted(chat.mismatched_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}[0]
    whole = r.prompt + r.chosen + r.rejected
    assert whole.count("<|start|>") == 3 == whole.count("<|end|>") and r.usable and r.n_prompt == 1


def test_one_long_conversation(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)] + [(2, 0, "assistant", "other")]
    r = {x.pair_id: x for x in chat.formatted(chat.mismatched_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert (r[1].n_prompt, r[1].n_chosen, r[1].n_rejected) == (2999, 1, 1) and not r[2].usable


# --- 6 lines ---


def plain_lines(rows, most=lines.EDITS):
    first, places = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, own in lines.lines_of(t.encode() if t is not None else None):
            first.setdefault(own, (d, i))
            places.append((d, i, own))
    lost = set()
    for a, b in combinations(first, 2):
        if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            lost.add(a if first[a] > first[b] else b)
    return {(d, i) for d, i, own in places if own in lost or first[own] < (d, i)}


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("large", [lines.LARGE, 0])
def test_lines(spark, monkeypatch, seed, large):
    monkeypatch.setattr(lines, "LARGE", large)
    rng = __import__("random").Random(seed)
    base = [sentence(rng, 6) for _ in range(12)]
    docs = []
    for d in range(40):
        own = []
        for _ in range(4):
            x = rng.choice(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "z" + x[k + 1 :]])
            own.append(rng.choice(["", "  "]) + x)
        docs.append((d, "\n".join(own)))
    docs += [(40, None), (41, ""), (42, "short\nshort"), (43, "é" * 30 + "\n" + "é" * 29 + "e")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    gone = plain_lines(docs)
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) == len(gone) > 0
    left = {r.doc_id: r.text for r in lines.clean_lines(df).collect()}
    touched = {d for d, _ in gone}
    assert left == {d: t for d, t in want.items() if d not in touched or t.strip()}


def test_lines_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BITS", 8)  # lets every line through
    text = sentence(__import__("random").Random(1), 8)
    df = spark.createDataFrame([(1, text), (2, text + "x"), (3, text + "xyz"), (5, sentence(__import__("random").Random(2), 30))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(df).collect()) == [(1, 0), (2, 1), (3, 1), (5, 0)]
    assert lines.dedup_lines(frame(spark, EMPTY)).count() == 0


def test_lines_of_rows_without_or_with_repeated_ids(spark):
    rng = __import__("random").Random(3)
    own = ["\n".join(sentence(rng, 6) for _ in range(3)) for _ in range(20)]
    rows = [(1, own[0]), (None, own[0]), *((None, t) for t in own[1:10]), *((7, t) for t in own[10:]), ((1 << 63) - 1, "a line of its own, long enough"), (None, None), (None, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_removed, r.text) for r in lines.dedup_lines(df).collect())
    assert got == Counter((d, 3, "") if (d, t) == (None, own[0]) else (d, 0, t) for d, t in rows)
    left = lines.clean_lines(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((d, t) for d, t in rows if (d, t) != (None, own[0]))


def test_equal_short_lines_go(spark):
    df = spark.createDataFrame([(1, "Yes.\n\nNo.\n}"), (2, "No.\n\n Yes. \nYes!"), (3, "}\n\n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()) == [(1, 0, "Yes.\n\nNo.\n}"), (2, 2, "\nYes!"), (3, 1, "\n")]
    assert sorted((r.doc_id, r.text) for r in lines.clean_lines(df).collect()) == [(1, "Yes.\n\nNo.\n}"), (2, "\nYes!")]


@pytest.mark.parametrize("edits_", [1, 2, 3])
def test_keys_and_finer_keys_meet(edits_):
    rng = __import__("random").Random(edits_)
    for _ in range(1500):
        a = bytes(rng.choice(b"abc ") for _ in range(rng.randint(20, 40)))
        b = bytearray(a)
        for _ in range(rng.randint(1, edits_)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([b"", bytes([b[k]]) + b"x", b"y"])
        if (b := bytes(b)) == a or len(b) < lines.MIN_BYTES:
            continue
        own, probe = sorted((a, b), key=len)
        keys, index, sigs = lines.keys_of([own, probe], edits_)
        met = {k for k, i in zip(keys.tolist(), index.tolist(), strict=True) if i == 0} & {k for k, i in zip(keys.tolist(), index.tolist(), strict=True) if i == 3}
        assert met and int(np.bitwise_count(sigs[0] ^ sigs[1])) <= lines.FLIPS * edits_
        finer = False
        for k in met:
            ks, ix, _ = lines.finer_keys([own, probe], np.array([k, k], np.uint64), np.array([0, 1]), edits_)
            finer |= bool({x for x, i in zip(ks.tolist(), ix.tolist(), strict=True) if i == 0} & {x for x, i in zip(ks.tolist(), ix.tolist(), strict=True) if i == 3})
        assert finer


def test_edit_distance():
    rng = __import__("random").Random(0)
    for _ in range(4000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 10)))
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 10))) if rng.random() < 0.3 else a[: rng.randint(0, 10)] + a[rng.randint(0, 10) :]
        for most in (1, 2, 3):
            assert lines.within(a, b, most) == (edits(a, b) <= most)


# --- 7 quality ---


def plain_features(text):
    words = space_words(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    own = [x for x in (text or "").split("\n") if space_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


@pytest.mark.parametrize("seed", SEEDS)
def test_quality(spark, tmp_path, seed):
    rows = corpus(seed) + [(900, "a ## b %% <x>\n\na ## b %% <x>", "en", "bad", 0)] + [(1000 + i, f"{i} short", "en", "bad", 0) for i in range(40)] + [(2000, sentence(__import__("random").Random(1), 40), "en", "bad", 0)]
    with_clashes(frame(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        r = got[d]
        n, *rest = plain_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert not (r.kept and r.base_failed)
    assert not got[2000].base_failed and not got[2000].kept  # its host fails
    kept = quality.keep_good(with_clashes(frame(spark, rows)))
    assert kept.columns == with_clashes(frame(spark, rows)).columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_quality_salted_join_and_empty(spark, monkeypatch):
    want = sorted(r.doc_id for r in quality.keep_good(frame(spark)).collect())
    monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)
    assert sorted(r.doc_id for r in quality.keep_good(frame(spark)).collect()) == want
    assert quality.keep_good(frame(spark, EMPTY)).count() == 0


def test_prior_shrinks_small_hosts():
    a, b = quality.prior(4, 1_000_000, 280_000_000_000, 40_000)
    assert abs(a / (a + b) - 0.25) < 1e-9 and quality.PRIOR_MIN <= a + b <= quality.PRIOR_MAX
    # rates that differ no more than by chance make the strongest prior, whatever the hosts' sizes
    rng = np.random.default_rng(0)
    for n in (10, 100):
        p = np.floor(rng.binomial(n, 0.2, 5000) / n * 1e6).astype(int).tolist()
        a, b = quality.prior(5000, sum(p), sum(x * x for x in p), 5000 * (1_000_000 // n))
        assert a + b > 150
        spread = np.floor(rng.binomial(n, rng.beta(2, 8, 5000)) / n * 1e6).astype(int).tolist()
        a, b = quality.prior(5000, sum(spread), sum(x * x for x in spread), 5000 * (1_000_000 // n))
        assert 7 < a + b < 14 and abs(a / (a + b) - 0.2) < 0.01


def test_hosts_are_rejected_by_their_shrunk_rate(spark, tmp_path):
    """Small hosts of which half fail stay where most hosts are good; a large one goes, with its good documents."""
    rng = __import__("random").Random(0)
    good = lambda: sentence(rng, 30)
    rows = [(i, good() if i % 20 else "short", "en", f"good{i % 40}", 1) for i in range(800)]
    rows += [(1000 + i, good() if i % 2 else "short", "en", "small", 1) for i in range(2)]
    rows += [(2000 + i, good() if i % 3 == 0 else "short", "en", "large", 1) for i in range(90)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, str(tmp_path)).collect()}
    dropped = {d for d, r in got.items() if not r.kept and not r.base_failed}
    assert dropped == {2000 + i for i in range(0, 90, 3)}
    con = connect_documents(tmp_path)
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, base_failed, kept FROM ({quality.OP7_SQL})").fetchall()}
    assert want == {d: (r.base_failed, r.kept) for d, r in got.items()}
    assert {r.doc_id for r in quality.keep_good(frame(spark, rows)).collect()} == {d for d, r in got.items() if r.kept}


# --- 8 sharding ---


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("shards", [8, 3])
def test_sharding_is_minimax(spark, seed, shards):
    rows = corpus(seed)
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[t or ""].append(d)
    groups = sorted((min(ds), len(ds) * (len(t.encode()) + 1)) for t, ds in texts.items())
    sizes = [w for _, w in groups]

    def feasible(capacity):
        used, room = 1, capacity
        for w in sizes:
            if w > room:
                used, room = used + 1, capacity
            room -= w
        return used <= shards

    best = next(c for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1) if feasible(c))
    out = sharding.minimax_shards(sharding.document_rows(with_clashes(frame(spark, rows))), shards).collect()
    loads, slots, shard_of = Counter(), defaultdict(list), {}
    for r in out:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shard_of[r.doc_id] = r.shard
    assert max(loads.values()) == best and len(out) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({shard_of[d] for d in ds}) == 1 for ds in texts.values())
    order = [shard_of[first] for first, _ in groups]
    assert order == sorted(order)


def test_sharding_at_the_edges(spark):
    assert sharding.minimax_shards(sharding.document_rows(frame(spark, EMPTY))).count() == 0
    rows = [(1, "a", "en", None, 1), (1, "a", "en", None, 1), (None, None, None, None, None), (2, "", "en", None, 0)]
    out = sharding.minimax_shards(sharding.document_rows(frame(spark, rows))).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 2, 2] and {r.text_crc32 for r in out} == {0, 3904355907}


# --- 9 n-gram join ---


def plain_sets(rows):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return sets


def plain_components(rows):
    sets = plain_sets(rows)
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(links, sets).items()}


def copies(seed):
    """Families of edited copies around the limit, whose links chain."""
    rng = __import__("random").Random(seed)
    rows = []
    for family in range(6):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([6, 20, 60, 120]))]
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            w = w[: len(w) - rng.randint(0, len(w) // 6)]
            rows.append((family * 100 + k * 5 % 14, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_components_of_near_duplicates(spark, seed):
    rows = corpus(seed) if seed < 2 else copies(seed)
    df = frame(spark, rows) if seed < 2 else spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(with_clashes(df)).collect()}
    assert got == plain_components(rows)
    left = {r.doc_id for r in ngram_join.keep_one(df).collect()}
    assert left == {d for d, (_, c) in got.items() if d == c}


def test_second_linking_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 0)
    rows = copies(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def families(seed, members=12):
    """Texts of one size that begin alike and go on differently, around the limit: groups of equal prefix whose members link in part."""
    rng = __import__("random").Random(seed)
    rows = []
    for family in range(5):
        base = [f"{rng.choice(VOCABULARY)}{family}" for _ in range(60)]
        tails = [[rng.choice(VOCABULARY) for _ in range(30)] for _ in range(3)]
        for k in range(members):
            w = base[: 40 + 5 * family] + tails[k % 3][: 20 - 4 * family]
            if k % 4 == 3:
                w[rng.randrange(len(w))] = "x"
            rows.append((100 * family + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "neighbours"), [(0, 2), (1, 0)])
def test_groups_of_equal_prefix(spark, monkeypatch, seed, neighbours):
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", neighbours)
    rows = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_prefix_groups(spark):
    rows = [(t, node, (9 << 32) + i) for node, own in {1: "abc", 2: "abc", 3: "abd", 5: "acb"}.items() for i, t in enumerate(map(ord, own))]
    rows += [(ord(t), 4, (8 << 32) + i) for i, t in enumerate("abc")] + [(ord("c"), 6, 9 << 32), (ord("c"), 7, 9 << 32)]
    got = ngram_join.prefix_groups(spark.createDataFrame(rows, ngram_join.POSTINGS)).collect()
    assert {(r.node, r["head"], r.repeats) for r in got} == {(1, 1, 3), (2, 1, 3), (3, 3, 3), (4, 4, 3), (5, 5, 3), (6, 6, 1), (7, 6, 1)}


def test_near_duplicates_by_filter(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = copies(5) + [(900 + i, t) for i, (_, t) in enumerate(copies(5)[::3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect()}
    assert got == plain_components(rows)
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {d for d, (_, c) in got.items() if d == c}


def test_near_duplicates_at_the_edges(spark):
    assert ngram_join.similarity_components(frame(spark, EMPTY)).count() == 0
    last = (1 << 63) - 1
    rows = [(None, "a b c d e f", "en", None, 1), (4, "A b c d e f", "en", None, 1), (4, "a b c d e f", "en", None, 1), (9, None, "en", None, None), (None, "p q r s t u", "en", None, 1), (None, "p q r s t u", "en", None, 1), (last, "v w x y z", "en", None, 1)]
    rows += [(4, f"other {i} text {i} of {i} this {i} id", "en", None, 1) for i in range(5)] + [(None, f"more {i} text {i} without {i} an {i} id", "en", None, 1) for i in range(5)]
    df = with_clashes(frame(spark, rows))
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect())
    assert out == Counter({(4, 2, 4): 2, (None, 2, 4): 1, (9, 0, 9): 1, (None, 2, None): 2, (last, 1, last): 1, (4, 5, 4): 5, (None, 5, None): 5})
    left = ngram_join.keep_one(df)
    assert left.columns == df.columns
    assert Counter(r.text.lower() if r.text else None for r in left.collect()) == Counter({t.lower() if t else None: 1 for _, t, *_ in rows})


def test_prefix_bounds_hold_for_all_sizes():
    for n_x in range(1, 40):
        for n_y in range(n_x, 56):
            need = -(-3 * (n_x + n_y) // 7)
            if need > n_x:
                continue
            # linked sets of these sizes: common tokens as late as they can stand in both orders
            x_own, y_own = n_x - need, n_y - need
            assert bool(ngram_join.may_link(n_x, x_own, n_y, y_own)) and x_own < ngram_join.probing(n_x) and y_own < ngram_join.probing(n_y)
            seen = min(ngram_join.probing(n_x) - x_own, ngram_join.probing(n_y) - y_own)
            assert seen >= ngram_join.common_needed(n_x, n_y) >= 1


def test_components_of_edges(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(200 + i, 201 + i) for i in range(30)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components(pairs, nodes)


# --- 10 personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = __import__("random").Random(0)
    for alphabet in ("ab.@_-", "0123456789 -", "01. -+()", "1.+@a ", "0123456789.@+é "):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(t) == plain_spans(t)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to john at example dot com today", ["john at example dot com"]),
        ("john.doe [at] mail [dot] example [dot] org.", ["john.doe [at] mail [dot] example [dot] org"]),
        ("jane(at)site(dot)net", ["jane(at)site(dot)net"]),
        ("j\u043ehn@ex\u0430mple.com", ["j\u043ehn@ex\u0430mple.com"]),
        ("\uff4a\uff4f\uff45\uff20example\uff0ecom", ["\uff4a\uff4f\uff45\uff20example\uff0ecom"]),
        ("us\u200ber@exam\u200bple.org", ["us\u200ber@exam\u200bple.org"]),
        ("plus four four two zero seven nine four six zero nine five eight!", ["plus four four two zero seven nine four six zero nine five eight"]),
        ("card four one one one 1111 1111 one one one one.", ["four one one one 1111 1111 one one one one"]),
        ("192 dot 168 dot 0 dot 1 and 10[.]0[.]0[.]255", ["192 dot 168 dot 0 dot 1", "10[.]0[.]0[.]255"]),
        ("999 dot 168 dot 0 dot 1", []),
        ("look at example.com and meet at noon", []),
        ("one two three four five six seven eight nine ten", []),
        ("plain a@b.co only", []),
        ("JOHN AT EXAMPLE DOT COM!", ["JOHN AT EXAMPLE DOT COM"]),
        ("john_at_example_dot_com", ["john_at_example_dot_com"]),
        ("ana arroba correo punto es, luc arobase site point fr", ["ana arroba correo punto es", "luc arobase site point fr"]),
        ("jane &#64; x&#46;org and joe%40y.net", ["joe%40y.net"]),
        ("bob @ example.com", ["bob @ example.com"]),
        ("sue@example dot com", ["sue@example dot com"]),
        ("four, one, one, one, 1111, 1111, 1111 one one one one", []),
        ("plus one, two, three, four, five, six, seven, eight, nine", ["plus one, two, three, four, five, six, seven, eight, nine"]),
        ("\u0664\u0661\u0661\u0661 \u0661\u0661\u0661\u0661 1111 1111", ["\u0664\u0661\u0661\u0661 \u0661\u0661\u0661\u0661 1111 1111"]),
        ("un dos tres. Deux points \u00e0 la ligne; der Punkt und die Null", []),
        ("the point at issue is the dot at the end. See that dot com boom", []),
        ("\u00e9t\u00e9 \u00e0 la plage, na\u00efve \u00f1and\u00fa", []),
        ("", []),
    ],
)
def test_disguises(text, found):
    assert [text[s["start"] : s["end"]] for s in pii.spans_of(text) if not s["base"]] == found


@pytest.mark.parametrize(
    "found",
    [
        "plus 44 20 7946 0958",
        "192.168.one.one",
        "one dot two dot three dot four",
        "+1 415 five 5 five 0100",
        "john.smith_at_example.com",
        "john at mail.example dot com",
        "n\u0130ne dot s\u0130x dot 3 dot 4",
    ],
)
def test_disguises_do_not_depend_on_the_rest(found):
    for text in (found, f"{found}; some [at] sign", f"\u043e; {found}"):
        assert found in [text[s["start"] : s["end"]] for s in pii.spans_of(text) if not s["base"]]


@pytest.mark.parametrize(
    ("found", "piece"),
    [
        ("j\u043ehn@example.com", "hn@example.com"),
        ("jo\u200bhn@example.com", "hn@example.com"),
        ("user@example.c\u043em", "user@example.c"),
        ("+44 20 7946 09\u06658", "+44 20 7946 09"),
    ],
)
def test_a_base_piece_does_not_hide_the_whole(found, piece):
    text = f"a@b.co, to {found}!"
    spans = [(text[s["start"] : s["end"]], s["base"]) for s in pii.spans_of(text)]
    assert sorted(spans) == sorted([("a@b.co", True), (piece, True), (found, False)])


def test_normalised_texts_map_back():
    rng = __import__("random").Random(0)
    pieces = ["a", "7", ".", "@", " at ", " [dot] ", " dot ", "\u043e", "\u200b", "\u00ad", "\u0665", "six ", "plus 4", "&#64;", "\u00e9", "-", " ", "x_at_y", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        own = pii.Normalised(text)
        spans = [own.source(i, i + 1) for i in range(len(own.text))]
        assert all(0 <= a < b <= len(text) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        for c, (a, b) in zip(own.text, spans, strict=True):
            source = text[a:b]
            assert c == source or len(source) == 1 and pii.ASCII[ord(source)] == c or b - a > 1 or c in "0123456789"
        # what lies between the spans is dropped characters only
        between = [text[x[1] : y[0]] for x, y in zip([(0, 0), *spans], [*spans, (len(text), len(text))], strict=True)]
        assert set("".join(between)) <= pii.GONE


def test_base_spans_stay_and_order(spark, tmp_path):
    text = "é a@b.co, 10.0.0.1, +44 20 7946 0958, 4111 1111 1111 1111, x at y dot org"
    frame(spark, [(7, text, "en", None, 1), (8, None, "en", None, None), (8, None, "en", None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op10_pii_deobfuscation(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    r = next(r for r in rows if r.doc_id == 7)
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    kinds = [s.split(":")[0] for s in r.spans.split(",")]
    assert kinds == ["email", "email", "ip", "card", "phone"]


@pytest.mark.parametrize("text", ["a@b.co, x at y dot org, j\u043ehn@example.com; " * 9_000, "a" * 200_000, "1" * 200_000, "@" * 50_000, "+1" + " " * 100_000, "1.1.1." * 20_000, "at dot " * 30_000, "one " * 50_000])
def test_scans_are_linear(text):
    import time

    began = time.perf_counter()
    pii.spans_of(text)
    assert time.perf_counter() - began < 5


def test_schema_is_the_documents_table(spark, sf):
    assert [c.split()[0] for c in SCHEMA.split(", ")] == spark.read.parquet(f"{sf}/documents.parquet").columns
