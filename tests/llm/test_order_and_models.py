"""Packing, shards, mixing, URL filter, language model and the pipeline against brute force and round trips."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalens.llm import elias_fano, hilbert_shards, ngram_trie, packing, pfair_mix, queries, url_filter

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
@pytest.mark.parametrize("ranks", [RANKS, None])
def test_packing_round_trip(table, ranks, request):
    docs = request.getfixturevalue(table)
    pieces = packing.pack(docs, JSON, ranks, length=128).collect()
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter(
        (r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect()
    )
    pieces.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    stream, sequences = [], Counter()
    for r in pieces:
        assert r["offset"] == sequences[r["sequence_id"]]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        sequences[r["sequence_id"]] += r["length"]
        if r["start"] == 0:
            stream.append((r["doc_id"], r["doc_tokens"], []))
        doc, size, ids = stream[-1]
        assert (doc, size, len(ids)) == (r["doc_id"], r["doc_tokens"], r["start"])
        ids.extend(r["ids"])
    assert Counter((d, tuple(ids)) for d, _, ids in stream) == want
    assert all(len(ids) == size for _, size, ids in stream)
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == 128 for s, n in sequences.items() if s < len(sequences) - 1)


def test_added_tokens_are_the_tokenizers():
    encode = packing.Encoder(JSON, RANKS, "<u2")
    for text in ("a <|endoftext|> b", "x  <|endoftext|>", "", "  ", "don't ſ ½\u2028日本"):
        ids = np.frombuffer(encode(text), dtype="<u2").tolist()
        assert ids == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_curve_index(spark):
    cells = spark.sql("select cast(a.id as int) a, cast(b.id as int) b, cast(c.id as int) c from range(8) a, range(8) b, range(8) c")
    rows = cells.withColumn("k", hilbert_shards.curve_index([cells.a, cells.b, cells.c], 3)).orderBy("k").collect()
    assert [r["k"] for r in rows] == list(range(512))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
def test_shards(table, request):
    docs = request.getfixturevalue(table)
    got = hilbert_shards.assign_shards(docs, 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    largest, total = max([0, *(r["size"] for r in got)]), sum(r["size"] for r in got)
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 7) <= largest
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_written_shards(spark, documents, tmp_path):
    hilbert_shards.write_shards(documents, 5, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5))
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, documents.collect()))


@pytest.mark.parametrize("table", ["odd", "repeated", "none"])
def test_shards_and_mix_keep_every_row_once(spark, table, request, tmp_path):
    """Rows of one id, rows without an id and fully equal rows are neither lost nor multiplied."""
    docs = request.getfixturevalue(table)
    no_id = docs.where("rank % 3 = 0").selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    docs = docs.unionByName(no_id)
    want = Counter(map(tuple, docs.collect()))
    mixed = pfair_mix.mix(docs, block_bytes=2000)
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == want
    if want:
        hilbert_shards.write_shards(docs, 5, str(tmp_path / "out"))
        assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*docs.columns).collect())) == want


@pytest.mark.parametrize("quotas", [[1, 1, 1], [5, 3, 2], [97, 1, 1, 1], [13, 7, 29, 51], [100]])
def test_schedule_is_pfair(spark, quotas):
    slots = sum(quotas)
    counts = spark.createDataFrame([(i + 1, q) for i, q in enumerate(quotas)], "number int, q long")
    rows = pfair_mix.schedule(counts, slots).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(slots))
    done = Counter()
    for t, r in enumerate(rows):
        assert r["released"] <= t < r["due"]
        done[r["number"]] += 1
        assert all(abs(done[i + 1] - q * (t + 1) / slots) < 1 for i, q in enumerate(quotas))


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
def test_mixing(table, request):
    docs = request.getfixturevalue(table)
    got = pfair_mix.interleave(docs, block_bytes=2000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    owner = {}
    for r in got:
        assert r["released"] <= r["slot"] < r["due"]
        assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    before = Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
        assert r["block"] == before[r["source"]] // 2000
        before[r["source"]] += r["size"]


def test_given_weights_and_untouched_columns(spark, documents):
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0), ("nowhere", 9.0)], "source string, weight double")
    got = pfair_mix.interleave(documents, weights).collect()
    assert len(got) == documents.count()
    mixed = pfair_mix.mix(documents)
    assert mixed.columns == documents.columns
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, documents.collect()))


PAGES = [
    ("http://a.NET/x?q#f", "a.net", "/x", "net/", "block"),
    ("https://www.example.net/en/1#top", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.com/de/7", "example.com", "/de/7", "example.com/de/", "block"),
    ("http://notexample.com/de/7", "notexample.com", "/de/7", None, None),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/fr", "x.org", "/fr", None, None),
    ("http://net", "net", "", None, None),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://É.Net?x", "É.net", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no address", "", "", None, "allow?"),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


def test_addresses_and_rules(spark):
    rows = [(i, p[0], "<p>cheap pills</p>", "h") for i, p in enumerate(PAGES)] + [(None, "http://q.net/", None, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(PAGES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == verdict
    assert url_filter.judge(pages.where("false")).count() == 0
    assert url_filter.judge(pages.where("url is null")).count() == 1


def test_verdicts_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    import re

    counts = Counter()
    for r in pages.collect():
        text = re.sub(r"<[^>]*>", " ", r["html"] or "").lower()
        counts.update(w for w in re.findall(r"[^\W\d_]+", text) if re.fullmatch(r"[a-z]{1,16}", w))
    total = sum(counts.values())

    def split(part):
        best = {0: (0.0, [])}
        for end in range(1, len(part) + 1):
            for n in range(min(end, 16), 0, -1):
                word = part[end - n : end]
                cost = math.log10(counts[word] / total) if counts[word] else math.log10(10 / total) - n
                if end not in best or best[end - n][0] + cost > best[end][0]:
                    best[end] = (best[end - n][0] + cost, best[end - n][1] + [word])
        return best[len(part)][1]

    for r in got.values():
        words = [w for part in re.split(r"[^a-z]+", r["host"]) if part for w in split(part)]
        assert (r["host_words"] or "") == " ".join(words)
    tokens = {}
    for page, r in got.items():
        path = ["#" if t.isnumeric() else t for t in re.findall(r"[^\W_]+", r["path"].lower())]
        tokens[page] = [f"h:{w}" for w in (r["host_words"] or "").split()] + [f"p:{t}" for t in path]
    sums = {c: Counter(t for p, r in got.items() if r["rule"] and r["verdict"] == c for t in tokens[p]) for c in ("block", "allow")}
    n = {c: sum(1 for r in got.values() if r["rule"] and r["verdict"] == c) for c in sums}
    size = {c: sum(s.values()) + url_filter.BUCKETS for c, s in sums.items()}
    for page, r in got.items():
        odds = math.log((n["block"] + 1) / (n["allow"] + 1))
        for t in tokens[page]:
            odds += math.log((sums["block"][t] + 1) / size["block"]) - math.log((sums["allow"][t] + 1) / size["allow"])
        assert r["log_odds"] == pytest.approx(odds, abs=1e-4)
        if not r["rule"]:
            assert r["verdict"] == ("block" if r["log_odds"] > 0 else "allow")


@pytest.mark.parametrize("n,top", [(1, 2**64), (50, 60), (4000, 2**64), (5000, 9000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top - 1, n, dtype=np.uint64, endpoint=True))
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)])
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    want = np.where(values[place] == asked, place, -1)
    assert (elias_fano.find(elias_fano.encode(values), asked) == want).all()


def test_elias_fano_of_a_frequent_context():
    """Most numbers in a small part of the range, as a frequent context gives: long runs of ones, few zeros."""
    rng = np.random.default_rng(4)
    near = np.uint64(1 << 62) + rng.integers(0, 1 << 30, 30_000, dtype=np.uint64)
    values = np.unique(np.concatenate([near, rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)]))
    asked = np.concatenate([values, values + np.uint64(1), values - np.uint64(1)])
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    want = np.where(values[place] == asked, place, -1)
    assert (elias_fano.find(elias_fano.encode(values), asked) == want).all()


def test_a_frequent_context_is_looked_up_once_and_searched_in_few_steps(monkeypatch):
    """The search asks for the span of a context, not of each successor, and halves at most 32 numbers of it."""
    rng = np.random.default_rng(5)
    context = np.repeat(rng.integers(0, 2**34, 40, dtype=np.uint64), 3000) << np.uint64(30)
    values = np.unique(context | rng.integers(0, 2**30, len(context), dtype=np.uint64))
    asked = np.unique(np.concatenate([values[::7], values[::9] + np.uint64(1)]))
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    counted = Counter()
    for name in ("_nth_zero", "_low_of"):
        old = getattr(elias_fano, name)
        monkeypatch.setattr(elias_fano, name, lambda code, i, name=name, old=old: counted.update({name: len(i)}) or old(code, i))
    got = elias_fano.find(elias_fano.encode(values), asked)
    assert (got == np.where(values[place] == asked, place, -1)).all()
    assert counted["_nth_zero"] < len(asked) / 50 and counted["_low_of"] <= 6 * len(asked)


@pytest.mark.parametrize("low_bits", [0, 1, 7, 40, 57, 58, 63])
def test_elias_fano_of_any_width(low_bits):
    rng = np.random.default_rng(low_bits)
    high = rng.integers(0, min(2 ** (64 - low_bits), 300), 5000, dtype=np.uint64)
    values = np.unique(high << np.uint64(low_bits) | rng.integers(0, 2**low_bits, 5000, dtype=np.uint64))
    code = elias_fano.encode(values, low_bits)
    asked = rng.permutation(np.concatenate([values, values + np.uint64(1)]))
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    want = np.where(values[place] == asked, place, -1)
    assert (elias_fano.search(code, *elias_fano.spans(code, asked >> np.uint64(low_bits)), asked) == want).all()
    assert (elias_fano.find(code, asked) == want).all()


class _Docs:
    """Stands in for a DataFrame, to run a task's function here."""

    def mapInArrow(self, run, schema):
        return run


def test_a_pass_over_the_texts_holds_few_arrays(monkeypatch):
    """Beside its texts a task that counts triples holds at most seven arrays and a half of the length of a chunk, temporaries included."""
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 300, 5000))) for _ in range(200)]
    batch = ngram_trie.pa.RecordBatch.from_arrays([ngram_trie.pa.array(texts)], names=["body"])
    monkeypatch.setattr(ngram_trie, "_look_up", lambda *a: iter(()))
    monkeypatch.setattr(ngram_trie, "_pair_files", lambda *a: None)
    model = ngram_trie.Model("", 0, 0, 0.5, 1, (), (1,))
    tracemalloc.start()
    assert not list(ngram_trie._triple_runs(_Docs(), model)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7.5 * 8 * 200 * 5001


def test_children_are_counted():
    rng = np.random.default_rng(7)
    above, words = (rng.choice(rng.integers(0, 2**64 - 1, 60, dtype=np.uint64), 5000) for _ in range(2))
    pairs, place, short, counts = ngram_trie._counted_children(above.copy(), words.copy())
    got = dict(zip(zip(pairs[place].tolist(), short.tolist()), counts.tolist()))
    assert got == Counter(zip(above.tolist(), (words >> np.uint64(24)).tolist()))
    assert (np.diff(place.astype(float) * 2.0**40 + short) > 0).all() and (np.diff(pairs.astype(float)) > 0).all()


def test_the_files_of_a_large_trie_stay_open(tmp_path, monkeypatch):
    """Each chunk of tokens meets every file, so a smaller number of open ones would open each again and again."""
    opened, old = [], ngram_trie._mapped
    monkeypatch.setattr(ngram_trie, "_mapped", lambda *a: opened.append(a[1]) or old(*a))
    for i in range(8000):
        ngram_trie._write(str(tmp_path), f"pairs-{i}", {})
    for _ in range(2):
        for i in range(8000):
            ngram_trie._open(str(tmp_path), f"pairs-{i}")
    assert len(opened) == 8000


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
@pytest.mark.parametrize("per_file", [None, 500])
def test_language_model(table, per_file, request, monkeypatch):
    if per_file:
        monkeypatch.setattr(ngram_trie, "PAIRS_PER_FILE", per_file)
        monkeypatch.setattr(ngram_trie, "WORDS_PER_FILE", per_file)
    docs = request.getfixturevalue(table)
    got = ngram_trie.train_and_score(docs).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    for d, w in rows:
        if not out(d):
            words.update(w)
            pairs.update(zip([b"", *w[:-1]], w))
    n, v = sum(words.values()), len(words)
    n1, n2 = (sum(c == k for c in pairs.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    after = Counter(a for a, _ in pairs)
    want = Counter()
    for d, w in rows:
        single = [(words[x] + 1) / (n + v + 1) for x in w]
        full = 0.0
        for a, x, p in zip([b"", *w[:-1]], w, single):
            count = ngram_trie.count_of(ngram_trie.quantise(np.array([pairs[a, x]])))[0]
            full += math.log10(
                min(1, max(count - discount, 0) / words[a] + discount * after[a] / words[a] * p) if words[a] else p
            )
        known = sum(words[x] > 0 for x in w)
        want[(d, out(d), len(w), known, n, round(sum(map(math.log10, single)), 4))] += 1
        mine = [r for r in got if r["doc_id"] == d and r["n_tokens"] == len(w)]
        assert min(abs(r["score"] - full) for r in mine) < 5e-4 * len(w)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
@pytest.mark.parametrize("per_file", [None, 500])
def test_language_model_of_three_words(table, per_file, request, monkeypatch):
    """Two words of context, by brute force; with small files the children of a file of pairs are spread over several."""
    if per_file:
        monkeypatch.setattr(ngram_trie, "PAIRS_PER_FILE", per_file)
        monkeypatch.setattr(ngram_trie, "WORDS_PER_FILE", per_file)
    docs = request.getfixturevalue(table)
    got = ngram_trie.train_and_score(docs, order=3).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    assert len(got) == len(rows)
    words, pairs, triples = Counter(), Counter(), Counter()
    for d, w in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            words.update(w)
            pairs.update(zip([b"", *w[:-1]], w))
            triples.update(zip([b"", *w[:-2]], w[:-1], w[1:]))
    n, v = sum(words.values()), len(words)
    met = lambda c, k: sum(x == k for x in c.values())
    cut, cut3 = (met(c, 1) / (met(c, 1) + 2 * met(c, 2)) if met(c, 1) else 0.5 for c in (pairs, triples))
    after, after3 = Counter(a for a, _ in pairs), Counter(t[:2] for t in triples)
    kept = lambda c: ngram_trie.count_of(ngram_trie.quantise(np.array([c])))[0]
    for d, w in rows:
        full = 0.0
        for i, x in enumerate(w):
            p = (words[x] + 1) / (n + v + 1)
            a = w[i - 1] if i else b""
            if words[a]:
                p = max(kept(pairs[a, x]) - cut, 0) / words[a] + cut * after[a] / words[a] * p
            above = (w[i - 2] if i > 1 else b"", a)
            if i and pairs[above]:
                p = max(kept(triples[*above, x]) - cut3, 0) / pairs[above] + cut3 * after3[above] / pairs[above] * p
            full += math.log10(min(1, p))
        mine = [r for r in got if r["doc_id"] == d and r["n_tokens"] == len(w)]
        assert min(abs(r["score"] - full) for r in mine) < 5e-4 * len(w)


def test_the_query_sees_two_words_of_context(spark):
    """Each word follows each other word, so only the pair before it tells what comes next."""
    texts = ["a b c d", "e b f d", "a x c y", "e x f y"] * 20
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, triples = (ngram_trie.train_and_score(docs, order=n).agg({"score": "sum"}).first()[0] for n in (2, 3))
    assert triples > pairs + 0.2 * len(rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(r["doc_id"], round(r["score"], 6)) for r in ngram_trie.train_and_score(docs, order=3).collect()}
    assert {(r["doc_id"], round(r["score"], 6)) for r in queries.op9_ngram_trie(spark, "/root/testdata/sf0.001").collect()} == want


def test_a_hot_pair_is_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "PAIRS_PER_FILE", 500)
    docs = spark.createDataFrame([(f"of the n{i}",) for i in range(5000)], "body string")
    model = ngram_trie.train(docs, order=3)
    assert max(model.parts) > 4
    sizes = [ngram_trie._mapped(model.folder, f"triples-{f}", ngram_trie._TRIPLES) for f in range(sum(model.parts))]
    sizes = [0 if f is None else int(f["head"][0]) for f in sizes]
    assert sum(sizes) == 5000 + 5000 + 1 and max(sizes) < 3000


def test_pairs_help_on_held_out_text(spark):
    rows = [r for r in queries.op9_ngram_trie(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_all_queries_are_registered(spark):
    import __spark_entry__ as contract
    import corpus_pipeline

    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing", "packing",
    ]
    assert names["pipeline"] is corpus_pipeline.run


def test_pipeline_stages(spark, documents):
    """Every stage on what the one before kept, against brute force."""
    import corpus_pipeline
    from stratalens.llm.common import store

    from .test_counts_and_spans import brute_counts, brute_lines
    from .test_forest_and_search import brute_near

    kept = [documents.withColumn("extra", documents.lang)]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(store(stage(spark, kept[-1], "/root/testdata/sf0.001")))
    assert all(k.columns == kept[0].columns for k in kept[1:-1])
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept[:-1]]

    counts = {d: brute_counts(r["text"]) for d, r in rows[0].items()}
    passing = {d for d, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    clean = {d for d in passing if 10 * counts[d][2] <= counts[d][1] and 100 * counts[d][3] <= 3 * counts[d][0]}
    assert clean <= rows[1].keys() <= passing

    lines = brute_lines([(d, r["text"]) for d, r in rows[1].items()], 1)
    assert {d: r["text"] for d, r in rows[2].items()} == {
        d: t for d, t in lines.items() if t == rows[1][d]["text"] or t.encode().split()
    }
    assert all(r["n_chars"] == len(r["text"]) for d, r in rows[2].items() if r["text"] != rows[1][d]["text"])

    texts = [(d, r["text"]) for d, r in rows[2].items()]
    assert rows[3].keys() == {d for (d, _), c in zip(texts, brute_near(texts)[1]) if d == c}
    assert rows[4] == rows[3]
    assert {r["doc_id"] for r in kept[-1].collect()} == rows[4].keys()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_agree_with_sql(spark, name, monkeypatch):
    from tools import check_oracles

    monkeypatch.setattr(check_oracles, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(check_oracles, "ORACLES", queries.ORACLES)
    assert check_oracles.compare(spark, "/root/testdata/sf0.001", name) == ""
