"""The operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

import collections
import datetime
import functools
import hashlib
import itertools
import math
import re
import textwrap
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, dedup, licences, mixing, neardup, packing, pii, planes, quality, queries, search, tokens, words, workspace
from tests.conftest import DATA
from tests.test_queries import TABLES, canonical

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, sequence_id int, copies int"
RNG = np.random.default_rng(5)
LEX = ["w%d" % k for k in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(LEX, n))


@functools.cache
def corpus():
    base = [prose(60) for _ in range(8)]
    near = []
    for k in (3, 20, 40):
        w = base[0].split()
        w[k] = "changed"
        near.append(" ".join(w))
    texts = base + near + [base[1], base[1].replace(" ", " \t\n", 3), base[2], None, "", "one two", "one two", prose(9000), "Él dijo: ¿qué?  naïve Straße 12'345 don't", "x" * 5000]
    rows = [(k, t, "en", ["a", "b", None, "d", ""][k % 5], None, "x", 1, 2, 3) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, base[3], None, "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return workspace.keep(spark.createDataFrame(corpus(), DOCS).repartition(5), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", ["Éé İx ΣΑΣ straße", "á ́x é", "don't we'll 12ab 's.", "<|endoftext|> x<|startoftext|>y", " a\x85b　c ", "x\x1cy", "ªº ŉ Ǆ ǅ", "!!!... it's. he'D", "中文 テスト😀", "K k", "a" * 100 + " " + "b" * 60, ""])
def test_word_memo_equals_the_library(tokenizer, text):
    found = tokens.encoder(tokens.default_vocabulary()).encode(text)
    assert np.frombuffer(found, "<u4").tolist() == ids_of(tokenizer, text)


def test_other_vocabularies_go_to_the_library():
    from tokenizers import Tokenizer

    other = tokens.default_vocabulary().replace("word_bpe_49k", "byte_bpe_50k")
    text = "  Two  blanks,\n\ttabs and Größe 12 don't <|endoftext|> "
    assert isinstance(tokens.encoder(tokens.default_vocabulary()), tokens.Words) and isinstance(tokens.encoder(other), tokens.Library)
    assert np.frombuffer(tokens.encoder(other).encode(text), "<u4").tolist() == ids_of(Tokenizer.from_file(other), text)
    assert tokens.encoder(other).encode(None) == b""


def test_planes_of_rows_of_one_id(spark, tokenizer):
    rows = [(7 if k % 3 else None, f"text {k}") for k in range(600)]
    path = workspace.folder(spark, "test-planes")
    manifest = planes.write(spark.createDataFrame(rows, "doc_id long, text string"), path, tokens.default_vocabulary(), files=6)
    found = sorted(planes.read(manifest, path).collect(), key=lambda r: r["start"])
    assert manifest.count() > 2 and collections.Counter(r["doc_id"] for r in found) == {None: 200, 7: 400}
    assert [r["doc_id"] for r in found] == [None] * 200 + [7] * 400 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    assert collections.Counter(r["ids_crc32"] for r in found) == collections.Counter(crc(ids_of(tokenizer, t) + [2]) for _, t in rows)


def test_word_hashes_of_long_and_odd_texts():
    import pyarrow as pa

    texts = ["a bb  a", None, "", "\t x\ny ", prose(400_000), "a"]
    hasher, seen = words.WordHasher(), collections.defaultdict(list)
    for first, _, hashes, owner in words.word_hashes(pa.array(texts), hasher):
        for h, o in zip(hashes.tolist(), owner.tolist()):
            seen[first + o].append(h)
    book = {}
    for k, t in enumerate(texts):
        split = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(split) == len(seen[k])
        for w, h in zip(split, seen[k]):
            assert book.setdefault(w, h) == h
    assert len(set(book.values())) == len(book)


def test_packing_is_whole_and_tight(docs, tokenizer):
    found = packing.pack(docs, tokens.default_vocabulary(), 512).toPandas()
    want = collections.Counter()
    for doc_id, text, *_ in corpus():
        ids = ids_of(tokenizer, text) + [1]
        want.update((doc_id, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512])) for k in range(0, len(ids), 512))
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == np.concatenate([[0], np.cumsum(rows["length"])[:-1]]).tolist() and rows["length"].sum() <= 512
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 512) + 1


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_packing_plan_is_near_the_bound(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(6.3, 1.1, n).astype(int), 1, 4096)
    runs, opened = packing.plan(collections.Counter(lengths.tolist()), 4096)
    fill = np.zeros(opened, int)
    for r in runs:
        np.add.at(fill, r.opened + np.arange(r.count) // r.each, r.length)
    assert fill.sum() == lengths.sum() and fill.max() <= 4096 and fill.min() > 0
    assert opened <= np.ceil(lengths.sum() / 4096) * 1.01 + 1


def test_planes_round_trip(spark, docs, tokenizer):
    path = workspace.folder(spark, "test-planes")
    found = planes.read(planes.write(docs, path, tokens.default_vocabulary(), files=3), path).toPandas()
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for doc_id, text, *_ in order:
        ids = ids_of(tokenizer, text) + [2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in found.itertuples()), key=lambda r: r[1])
    assert got == want


def test_plane_files_give_any_range(tmp_path):
    import pyarrow.fs as pafs

    ids = RNG.integers(0, 2**32, 3 * planes.BLOCK + 17, dtype=np.uint32)
    with open(tmp_path / "f", "wb") as out:
        writer = planes.Writer(out)
        writer.add(4, ids[:10].tobytes())
        writer.add(None, ids[10:].tobytes())
        writer.close()
    reader = planes.Reader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")))
    for s, e in ((0, 5), (planes.BLOCK - 1, planes.BLOCK + 1), (5, len(ids)), (7, 7)):
        assert (reader.ids(s, e) == ids[s:e]).all()
    assert [d[:3] for d in reader.documents()] == [(4, 0, 10), (None, 10, len(ids) - 10)]


def filled(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, got = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in got]
        left, total = share * sum(sizes.values()) - sum(got.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return got | {s: left * weight[s] / total for s in rest}
        got |= {s: cap * sizes[s] for s in over}


def test_mixing_meets_its_targets(docs):
    found = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source, *_ in corpus():
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    want = filled(dict(sizes))
    assert len(found) == len(corpus()) and all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in found)
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_mixing_comes_near_on_many_documents(spark):
    rows = [(k, prose(5 + k % 50), "s%d" % (k % 7 if k % 3 else 0)) for k in range(2000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(taken - target) <= 0.03 * target for _, taken, target in found)


def brute_top(rows, k):
    """By Python's integers; rows are (vec_id, vector)."""
    good = [(i, [math.floor(64 * Fraction(float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            cut = lambda s: max(search.LOW, min(search.HIGH, s))
            scores = sorted((-cut(sum(x * y for x, y in zip(v, w))), j is None, j or 0) for b, (j, w) in enumerate(good) if b != a)[:k]
            want += [(i, r + 1, None if z else j, -s) for r, (s, z, j) in enumerate(scores)]
    return want


@pytest.mark.parametrize("block", [32_768, 3])
def test_top_k_with_ties_nulls_and_repeats(spark, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", block), monkeypatch.setattr(search, "TILE_QUERIES", 2), monkeypatch.setattr(search, "TILE_ROWS", 50), monkeypatch.setattr(search, "SHARD_ROWS", 40)
    rows = [(k, [float(x) for x in RNG.integers(-2, 3, 4) / 4]) for k in range(120)]
    rows += [(20, rows[20][1]), (None, [1.0, 1.0, 1.0, 1.0]), (200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (220, []), (221, []), (240, [0.5, -0.3])]
    found = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 7).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(brute_top(rows, 7), key=key)


def test_top_k_of_large_components(spark):
    rows = [(k, [float(x) for x in RNG.integers(-9, 9, 3)]) for k in range(60)]
    rows += [(60, [1e30, 2.0, 0.0]), (61, [-1e30, 3.0, 1.0]), (80, [3e38, -3e38, 1.0]), (100, [1e6, -2e6, 0.013]), (101, [5e9, 1.0, -7e9]), (102, [123456789.0, 0.1, 1e12]), (103, [1e30, 1e30, 1e30])]
    found = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 9).collect()
    assert sorted(map(tuple, found)) == sorted(brute_top(rows, 9))


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    held = quality.score(docs, seen).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert np.mean([r["keep"] == bool(r["y"]) for r in held]) > 0.95


def test_quality_without_labels_keeps_all(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.score(docs, labels).collect()
    assert len(found) == len(corpus()) and all(r["keep"] for r in found)
    assert quality.score(none, labels).count() == 0


def brute_posteriors(rows, base):
    """(host_quality, path_quality, quality) of rows (host, path, evidence) by the written rules."""
    e = [x for *_, x in rows]
    n, rate = len(rows), min(max(sum(e) / len(rows), 1e-6), 1 - 1e-6)

    def sums(keys):
        count, total = collections.Counter(keys), collections.Counter()
        for k, x in zip(keys, e):
            total[k] += x
        return count, total

    def strength(count, spread):
        k, squares = len(count), sum(c * c for c in count.values())
        between = (spread - (k - 1) * rate * (1 - rate)) / max(n - squares / n, 1e-9) if k > 1 else 0
        return min(max(rate * (1 - rate) / between - 1, 1), 1e6) if between > 0 else 1e6

    hn, hs = sums([h for h, *_ in rows])
    a = strength(hn, sum(hs[h] ** 2 / hn[h] for h in hn) - n * rate * rate)
    host = {h: (hs[h] + a * rate) / (hn[h] + a) for h in hn}
    pn, ps = sums([(h, p) for h, p, _ in rows])
    b = strength(pn, sum(pn[k] * (ps[k] / pn[k] - host[k[0]]) ** 2 for k in pn))
    out = []
    for h, p, x in rows:
        path = min(max((ps[h, p] - x + b * host[h]) / (pn[h, p] - 1 + b), 1e-6), 1 - 1e-6)
        odds = math.log(x / (1 - x)) - math.log(base / (1 - base)) + math.log(path / (1 - path))
        out.append((host[h], path, 1 / (1 + math.exp(-odds))))
    return out, host, a, b


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_quality_posteriors_against_brute_force(spark, spread):
    """One host has a third of all rows; nulls are sites; sparse sites are drawn to the mean where sites are alike."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(1500):
        host = "big" if k % 3 == 0 else None if k % 50 == 1 else f"h{int(rng.integers(0, 60) ** 2 / 60)}"
        path = None if k % 7 == 0 else f"p{rng.integers(0, 4)}"
        mean = 0.6 if host is None else 0.6 + spread * math.sin(len(host) * 5 + ord(host[-1]))
        rows.append((host, path, float(np.clip(rng.beta(8 * mean, 8 * (1 - mean)), 1e-4, 1 - 1e-4))))
    made = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "doc_id long, host string, path string, evidence double, n int")
    found = sorted(quality.combined(made, 0.7, 0.5, ("n",)).collect())
    want, host, a, _ = brute_posteriors(rows, 0.7)
    assert len(found) == len(rows)
    for r, (h, p, q) in zip(found, want):
        assert np.allclose((r["host_quality"], r["path_quality"], r["quality"]), (h, p, q), rtol=1e-7) and (r["keep"] == (q >= 0.5) or abs(q - 0.5) < 1e-9) and r["n"] == 1
    assert (a > 100) == (spread == 0.0)  # alike sites are shrunk strongly
    sparse = [h for h, _ in collections.Counter(h for h, *_ in rows).most_common()[-6:]]
    means = {h: np.mean([x for g, _, x in rows if g == h]) for h in sparse}
    rate = np.mean([x for *_, x in rows])
    assert all(abs(host[h] - rate) <= abs(means[h] - rate) + 1e-12 for h in sparse)


def test_hosts_and_paths_of_addresses(spark):
    urls = {"https://A.example.org/blog/x.html": ("a.example.org", "/blog"), "http://user@b.example:80/x": ("b.example", "/"), "ftp://c.example": ("c.example", "/"), "no address": (None, None), "": (None, None), None: (None, None), "https://d.example?q=/a/b": ("d.example", "/")}
    made = spark.createDataFrame([(u,) for u in urls], "url string").select("url", quality.host_of(F.col("url")).alias("h"), quality.path_of(F.col("url")).alias("p"))
    assert {r["url"]: (r["h"], r["p"]) for r in made.collect()} == urls


def test_quality_of_pages_by_their_addresses(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    found = quality.score(pages, labels, quality.host_of(F.col("url")), quality.path_of(F.col("url")), labelled=20).collect()
    assert len(found) == pages.count() and all(r["host"] and r["path"].startswith("/") for r in found)


def test_chat_prefix(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (0, 3, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "x"), (1, 3, "assistant", "bad"), (2, 0, None, None), (2, None, "user", "late"), (None, 0, "user", "lost"), (4, 0, "user", "r"), (4, 0, "user", "r"), (5, 0, "user", "r")]
    sides = chat.neighbours(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = chat.segments(sides).collect()
    first = sorted((r["segment"], r["turn"], r["loss"]) for r in found if r["pair_id"] == 0)
    assert first == [("chosen", 3, 1), ("prompt", 0, 0), ("prompt", 1, 0), ("prompt", 2, 0), ("rejected", 3, 1)]
    assert {(r["segment"], r["times"]) for r in found if r["pair_id"] == 2} == {("chosen", 2), ("rejected", 1)}
    assert {r["segment"] for r in found if r["pair_id"] == 1} == {"chosen"} and len(found) == 9


def brute_pairs(turns):
    """{(pair, part): (prompt, chosen, rejected, the texts under loss)} by the written rules."""
    sides = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for conv, turn, role, text in turns:
        if conv is not None:
            sides[conv // 2][conv % 2][chat.LAST if turn is None else turn, role or "user", text or ""] += 1
    out = collections.defaultdict(lambda: [[], [], [], [], []])
    for pair, (a, b) in sides.items():
        cut = min((t[0] for t in {*a, *b} if a[t] != b[t]), default=math.inf)
        for t in sorted({*a, *b}):
            row = out[pair, None if t[0] == chat.LAST else t[0] // chat.PART_TURNS]
            whole = f"<|im_start|>{t[1]}\n{t[2]}<|im_end|>\n"
            for k, there in enumerate((t[0] < cut, t[0] >= cut and a[t], t[0] >= cut and b[t])):
                if there:
                    row[k].append(whole)
                    if k and t[1] == "assistant":
                        row[2 + k].append(f"{t[2]}<|im_end|>")
    return {k: ("".join(p), "".join(c), "".join(r), x, y) for k, (p, c, r, x, y) in out.items()}


def test_chat_pairs_against_brute_force(spark):
    rng = np.random.default_rng(8)
    turns = []
    for pair in range(40):
        shared, n = rng.integers(0, 5), rng.integers(1, 8)
        for side in range(2 if pair % 5 else 1):
            for t in range(n):
                text = f"{'same' if t < shared else 'own%d' % side} {t} é😀" if rng.random() < 0.95 else None
                turns.append((2 * pair + side, t if rng.random() < 0.97 else None, ("user", "assistant")[t % 2] if rng.random() < 0.95 else None, text))
    turns += [turns[3], turns[3], (None, 1, "user", "lost"), (100, 0, "user", "x" * 300_000), (101, 0, "user", "x" * 300_000), (101, 1, "assistant", "y" * 500_000)]
    turns += [(c, t, ("user", "assistant")[t % 2], f"long {t}" if t < 9000 else f"end {c}") for c in (200, 201) for t in range(9005)]
    extra = spark.createDataFrame([(*t, 5, "s") for t in turns], "conv_id int, turn int, role string, text string, n long, segment string").repartition(3)
    found = chat.format_pairs(chat.neighbours(extra)).collect()
    got = {}
    for r in found:
        under = [[r[side][x["start"] : x["end"]] for x in r[f"{side}_loss"]] for side in ("chosen", "rejected")]
        got[r["pair_id"], r["part"]] = (r["prompt"], r["chosen"], r["rejected"], *under)
    assert len(found) == len(got) and got == brute_pairs(turns)
    assert [p for i, p in sorted(got, key=str) if i == 100] == [0, 1, 2]


def test_dedup_against_brute_force(docs):
    found = dedup.dedup(docs).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = collections.Counter()
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want.update((i, first, len(ids)) for i in ids)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups) == dedup.deduplicated(docs).count()


def test_deduplicated_rows_that_are_no_file_scan(spark, docs):
    made = spark.createDataFrame(corpus(), DOCS)
    want = collections.Counter(r[0] for r in dedup.deduplicated(docs).select("doc_id").collect())
    for rows in (made, docs.where("doc_id < 9").unionByName(docs.where("doc_id >= 9 or doc_id is null"))):
        assert collections.Counter(r[0] for r in dedup.deduplicated(rows).select("doc_id").collect()) == want
    stayed = corpus_pipeline.drop_copies(spark, made, "").select("doc_id").collect()
    assert collections.Counter(r[0] for r in stayed) == want


@pytest.mark.parametrize("hex_digits, files", [(1, 2), (2, 1000)])
def test_dedup_where_digests_clash(docs, hex_digits, files):
    """A weak digest gives many texts one key; the groups are still those of the texts."""
    found, want = dedup.dedup(docs, files=files, hex_digits=hex_digits).collect(), dedup.dedup(docs).collect()
    told = lambda rows: collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    assert told(found) == told(want)


@pytest.mark.parametrize("hex_digits", [64, 1, 0])
def test_dedup_over_one_state(spark, hex_digits):
    place = workspace.folder(spark, "test-state")
    calls = [[(5, "a  b"), (6, "c"), (7, "a b")], [(1, "a\tb"), (2, "d"), (3, "d"), (None, None)], [(9, "c"), (8, ""), (4, "e")]]
    want = [{(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)}, {(1, 5, 3, False), (2, 2, 2, True), (3, 2, 2, False), (None, None, 1, True)}, {(9, 6, 2, False), (8, None, 2, False), (4, 4, 1, True)}]
    for rows, expected in zip(calls, want):
        made = workspace.keep(spark.createDataFrame(rows, "doc_id long, text string"), "test-part")
        found = dedup.dedup(made, state=place, hex_digits=hex_digits).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found} == expected


@pytest.mark.parametrize("most", [4 << 20, 0])
def test_rows_without_others(spark, most, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", most)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "a"), (3, "c"), (3, "c")], "k long, s string")
    gone = spark.createDataFrame([(1, "b"), (2, None), (None, "a"), (4, "z")], "k long, s string")
    both = {(r["k"], r["s"]) for r in workspace.without(rows, gone, "k", "s").collect()}
    assert both == {(1, "a"), (None, "a"), (3, "c")} and workspace.without(rows, gone, "k").count() == 3


def test_dedup_of_nothing(none):
    assert dedup.dedup(none).count() == 0 and dedup.deduplicated(none).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("tile", [768, 3])
def test_near_duplicates_against_brute_force(docs, tile, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = [(r[0], shingles(r[1])) for r in corpus()]
    links, edges = collections.Counter(), collections.defaultdict(set)
    good = [(i, s) for i, s in rows if s and i is not None]
    for (a, x), (b, y) in itertools.combinations(good, 2):
        if len(x & y) >= 0.8 * len(x | y):
            edges[a].add(b), edges[b].add(a)
            links[a] += 1
            links[b] += 1

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in edges[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    found = neardup.join(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["doc_id"]
        if i is not None and i != 3:  # id 3 occurs twice: each row links to the other
            assert (r["class_id"], r["links"]) == (reach(i), links[i]), i


def test_near_duplicates_of_one_id_with_two_texts(spark):
    one, two = prose(80).split(), prose(80).split()
    texts = [(5, one), (1, [*one[:-1], "x"]), (5, two), (6, [*two[:-1], "x"]), (7, [*two[:-1], "y"]), (5, prose(80).split()), (8, one)]
    made = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "doc_id long, text string")
    found = sorted((r["doc_id"], r["class_id"], r["links"], r["representative"]) for r in neardup.join(made).collect())
    assert found == [(1, 1, 2, 1), (5, 1, 2, 5), (5, 5, 0, 5), (5, 5, 2, 5), (6, 5, 2, 6), (7, 5, 2, 7), (8, 1, 2, 5)]


@pytest.mark.parametrize("tile", [768, 4])
def test_near_duplicates_along_a_chain(spark, tile, monkeypatch):
    """Neighbours are similar, others not: the group is verified bucket by bucket where tiles are small."""
    monkeypatch.setattr(neardup, "TILE", tile)
    told, spots = [], neardup._spots
    monkeypatch.setattr(neardup, "_spots", lambda *a: told.append(spots(*a)) or told[-1])
    run, group = prose(700).split(), prose(90).split()
    texts = [run[8 * k : 8 * k + 104] for k in range(70)] + [[*group[:k], f"y{k}", *group[k + 1 :]] for k in range(0, 60, 6)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    linked = {(a, b) for a in range(80) for b in range(80) if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(k, 0 if k < 70 else 70) for k in range(80)}
    assert all(r["links"] == sum(a == r["doc_id"] for a, _ in linked) for r in found)
    assert any(s["band"] >= 0 for r in told[0].collect() for s in r["spots"]) == (tile == 4)


def test_near_duplicates_of_nothing(none):
    assert neardup.join(none).count() == 0


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4111 1111 1111 1111, again 4111111111111111.", "born 1984-02-29 or 29.02.1984; not 2023-02-30", "ip 10.0.255.1 not 10.0.256.1", "+1 (982) 555-2127 and 078-05-1120", "mail a.b@mail1.example.com twice a.b@mail1.example.com", None, "", "number 4111111111111112 stays", "no numbers"]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, cards int"), "k").collect()}
    one, two = re.findall(r"\d[\d ]{14,18}\d", found[0]["text"])
    assert one.replace(" ", "") == two and luhn(two) and two != "4111111111111111" and found[0]["cards"] == 2
    iso, day = re.findall(r"born (\S+) or (\S+);", found[1]["text"])[0]
    assert iso == "-".join(reversed(day.split("."))) and iso != "1984-02-29" and "2023-02-30" in found[1]["text"]
    assert "10.0.256.1" in found[2]["text"] and "10.0.255.1" not in found[2]["text"] and found[2]["addresses"] == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{2}-\d{4}", found[3]["text"]) and "555-2127" not in found[3]["text"]
    a, b = re.findall(r"\S+@\S+", found[4]["text"])
    assert a == b and "mail1" not in a
    assert [found[k]["text"] for k in (5, 6, 7, 8)] == texts[5:9] and found[5]["pseudonyms"] == 0


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(6 * 35).select((F.col("id") / 35).cast("long").alias("a"), (F.col("id") % 35).alias("b"))
    made = pairs.select(pii.feistel(F.col("a"), F.col("b"), F.lit(6), F.lit(35), "k", F.lit("t")).alias("p")).select("p.*").collect()
    assert {tuple(r) for r in made} == {(a, b) for a in range(6) for b in range(35)}


def brute_pair(a, b, m, n, kind, key="k"):
    draw = lambda turn, half: int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)
    for turn in range(1, pii.ROUNDS + 1):
        if turn % 2:
            a = (a + draw(turn, b)) % m
        else:
            b = (b + draw(turn, a)) % n
    return a, b


def brute_digits(d, kind):
    u = len(d) // 2
    a, b = brute_pair(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{kind}:{len(d)}")
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def refill(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def brute_date(y, m, d):
    try:
        number = (datetime.date(int(y), int(m), int(d)) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= number < 17 * 4297:
        return None
    a, b = brute_pair(*divmod(number, 4297), 17, 4297, "date")
    return datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)


def brute_pseudonym(s):
    """The pseudonym of one value of a known shape, by the written rules; the value itself where it isn't valid."""
    digits = re.sub("[^0-9]", "", s)
    if "@" in s:
        return "u" + hashlib.sha256(f"k|email|{s.lower()}".encode()).hexdigest()[:12] + "@example.invalid"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        return str(brute_date(*s.split("-")) or s)
    if re.fullmatch(r"\d\d([./])\d\d[./]\d{4}", s):
        one, two, y = s[:2], s[3:5], s[6:]
        if found := brute_date(y, two, one):
            return found.strftime(f"%d{s[2]}%m{s[5]}%Y")
        found = brute_date(y, one, two)
        return found.strftime(f"%m{s[2]}%d{s[5]}%Y") if found else s
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", s):
        part = [int(x) for x in s.split(".")]
        if max(part) > 255:
            return s
        a, b = brute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, "address")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", s):
        areas = [k for k in range(1, 900) if k != 666]
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area not in areas or not group or not serial:
            return s
        a, b = brute_pair(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "social")
        return f"{areas[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if s.startswith("+") and not s.startswith("+1"):
        country = re.match(r"\+(\d+)", s)[1]
        return refill(s, country + brute_digits(digits[len(country) :], f"phone:{country}"))
    if len(digits) < 12:
        ten = digits[-10:]
        area, rest = int(ten[:3]), int(ten[3:])
        if area < 200:
            a, b = brute_pair(area, rest, 200, 10**7, "phone:low")
        elif rest < 2 * 10**6:
            a, b = brute_pair(area - 200, rest, 800, 2 * 10**6, "phone:odd")
            a += 200
        else:
            a, b = brute_pair(area - 200, rest - 2 * 10**6, 800, 8 * 10**6, "phone")
            a, b = a + 200, b + 2 * 10**6
        return refill(s, digits[:-10] + f"{a:03d}{b:07d}")
    if not luhn(digits):
        return s
    body = brute_digits(digits[:-1], "card")
    return refill(s, next(x for x in (body + c for c in "0123456789") if luhn(x)))


def test_pseudonyms_against_brute_force(spark):
    rng = np.random.default_rng(3)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = lambda n: next(x for b in [d(n - 1)] for x in (b + c for c in "0123456789") if luhn(x))
    shapes = [
        lambda: f"{rng.integers(1890, 2110)}-{rng.integers(1, 14):02d}-{rng.integers(1, 33):02d}", lambda: f"{rng.integers(1, 33):02d}/{rng.integers(1, 33):02d}/{rng.integers(1900, 2100)}",
        lambda: f"{rng.integers(1, 32):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2100)}", lambda: ".".join(str(x) for x in rng.integers(0, 260, 4)), lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 {d(3)}-{d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"2{d(2)} 9{d(2)} {d(4)}", lambda: f"+49 {d(3)} {d(4)} {d(2)}", lambda: f"+{rng.integers(20, 99)}-{d(2)}-{d(4)}",
        lambda: card(16), lambda: refill("#### #### #### ####".replace("#", "0"), card(16)), lambda: card(13), lambda: card(19), lambda: d(16), lambda: f"{d(3)}.x%{d(2)}@a-{d(1)}.b.example",
    ]
    values = [[shapes[k % len(shapes)]() for k in range(j, j + 6)] for j in range(240)]
    rows = [(k, "start " + " ;\n".join(v) + " end") for k, v in enumerate(values)]
    found = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for k, v in enumerate(values):
        assert found[k] == "start " + " ;\n".join(map(brute_pseudonym, v)) + " end"


def test_pseudonyms_stay_valid(spark):
    socials = spark.range(2000).select("id", F.format_string("%03d-%02d-%04d", F.col("id") % 899 + 1, F.col("id") % 99 + 1, F.col("id") * 5 % 9999 + 1).alias("text"))
    for r in pii.pseudonymise(socials, "other", keep=("id",)).collect():
        area, group, serial = map(int, r["text"].split("-"))
        assert r["socials"] == (r["id"] % 899 + 1 != 666) and (not r["socials"] or (0 < area < 900 and area != 666 and group and serial))
    phones = spark.range(2000).select(F.format_string("%d-%d-%04d", F.col("id") % 800 + 200, F.col("id") * 7 % 800 + 200, "id").alias("text"), "id")
    found = [r["text"] for r in pii.pseudonymise(phones, "other", keep=("id",)).collect()]
    assert all(re.fullmatch(r"[2-9]\d\d-[2-9]\d\d-\d{4}", t) for t in found) and len(set(found)) == 2000


def test_pseudonyms_of_very_long_texts(spark):
    run = "QUJD" * 262_144  # 1 MB without a blank
    labels = "a@" + "b." * 100_000
    texts = [run, run + "@x.example", labels + "1", labels + "com", "1." * 300_000, "+1 " * 200_000, "4" * 500_000, "a@" * 300_000, "-" * 500_000 + "1984-02-29", None, ""]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(0, run, 7)]
    began = time.time()
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, emails int").repartition(4), "k").collect()
    assert time.time() - began < 60 and len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    assert got[0]["text"] == run and got[1]["text"] == brute_pseudonym(run + "@x.example") and got[1]["emails"] == 1
    assert got[2]["text"] == labels + "1" and got[9]["text"] is None and got[10]["text"] == "" and got[9]["pseudonyms"] == 0


def test_licences():
    known = licences.table()
    longest = max(map(len, known))
    text = "foo\nReleased under the MIT License.\nbar baz\n" + licences.SENTENCES["bsd-redistribution"].replace(" and ", "\nand ") + "\n * " + licences.SENTENCES["bsd-source"] + "\n" + licences.SENTENCES["bsd-binary"]
    names = [n for _, n in licences.identifiers(text, known, longest)]
    assert names == ["mit-released", "bsd-redistribution", "bsd-source", "bsd-binary"]
    assert licences.matched(names) == ["MIT", "BSD-2-Clause"] and licences.matched(names[::-1]) == ["MIT"]


def brute_licences(text):
    """By plain search: known sentences in the words of the text, longest first at each place, then the rules."""
    cut = re.sub(r"(?<=[.!?;:])\s+|\n", "\0", text or "")  # sentence ends
    parts = [w for w in (re.sub("[^0-9a-z]+", " ", p.lower()).strip() for p in cut.split("\0")) if w]
    known = {re.sub("[^0-9a-z]+", " ", t.lower()).strip(): name for name, t in licences.SENTENCES.items()}
    names, k = [], 0
    while k < len(parts):
        hits = [j for j in range(k + 1, min(k + 60, len(parts)) + 1) if " ".join(parts[k:j]) in known]
        if hits:
            names.append(known[" ".join(parts[k : hits[-1]])])
        k = hits[-1] if hits else k + 1
    free, found = list(names), []
    for licence, sequence in licences.RULES:
        while True:
            places, at = [], -1
            for name in sequence:
                at = next((p for p in range(at + 1, len(free)) if free[p] == name), None)
                if at is None:
                    break
                places.append(at)
            if len(places) < len(sequence):
                break
            found.append((places[0], licence))
            for p in places:
                free[p] = None
    return " ".join(names), " ".join(licence for _, licence in sorted(found)), len(names)


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))


def test_licence_scan_against_brute_force(spark):
    rng = np.random.default_rng(6)
    order, texts = list(licences.SENTENCES), []
    for _, rule in licences.RULES:  # each rule's sentences in order, out of order, wrapped and among prose
        sentences = [licences.SENTENCES[name] for name in rule]
        texts += [" ".join(sentences), "\n * ".join(sentences), wrapped("Some words. " + " More words. ".join(sentences), 60), " ".join(sentences[::-1]).upper()]
    for _ in range(120):
        names = rng.choice(order, rng.integers(0, 6))
        texts.append(wrapped(prose(9) + ". " + f". {prose(5)}. ".join(licences.SENTENCES[n] for n in names), int(rng.integers(30, 200))))
    texts += [None, "", prose(60_000) + ".\n" + licences.SENTENCES["mpl2"], "licence " * 200_000, "permission.\n" * 100_000, licences.SENTENCES["mit-notice"][:-20]]
    rows = [(k, t, "x", 3) for k, t in enumerate(texts)] + [(0, texts[0], "x", 3), (None, texts[4], "x", 3)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licences string, n_sentences int").repartition(4)).collect()
    got = collections.Counter((r["doc_id"], r["sentences"], r["licences"], r["n_sentences"]) for r in found)
    assert got == collections.Counter((i, *brute_licences(t)) for i, t, *_ in rows)


# Whole texts of short licences, as published.
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
GPL3_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""


@pytest.mark.parametrize("text, licence", [(MIT, "MIT"), (ZLIB, "Zlib"), (GPL3_HEAD, "GPL-3.0")])
def test_whole_licence_texts(text, licence):
    known = licences.table()
    assert licences.matched([n for _, n in licences.identifiers(text, known, max(map(len, known)))]) == [licence]


def test_licence_scan_of_odd_rows(docs, none):
    found = licences.scan(docs).collect()
    assert len(found) == len(corpus()) and not any(r["n_sentences"] for r in found) and licences.scan(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert canonical(queries.queries()[name](spark, DATA).toPandas()) == canonical(con.execute(queries.oracle_sql()[name]).df())


def test_empty_tables(none, spark):
    assert packing.pack(none, tokens.default_vocabulary()).count() == 0
    path = workspace.folder(spark, "test-planes")
    assert planes.read(planes.write(none, path, tokens.default_vocabulary()), path).count() == 0
    assert mixing.mix(none).count() == 0 and pii.pseudonymise(none, "k").count() == 0
    assert search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert chat.format_pairs(chat.neighbours(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline_stages_keep_rows_and_columns(spark, docs):
    (spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(12)], "doc_id long, quality int, toxic int")).write.mode("overwrite").parquet(folder := workspace.folder(spark, "t") + "/labels.parquet")
    now = docs.drop("digest", "size", "sequence_id", "copies")
    for name, stage in corpus_pipeline.STAGES[1:]:
        now = workspace.keep(stage(spark, now, folder.removesuffix("/labels.parquet")), "test-stage")
        if name != "best-fit packing":
            assert now.columns == list(corpus_pipeline.COLUMNS)
    assert now.count() > 0


def test_pipeline_decides_by_row(spark):
    junk, good = "@@ ## 11 $$ %% 22 && ** 33", prose(80)
    labels = [(k, k % 2, 0) for k in range(20)]
    labels_path = workspace.folder(spark, "t")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{labels_path}/labels.parquet")
    rows = [(k, prose(80) if k % 2 else junk + " ?" * k) for k in range(20)] + [(None, junk), (None, good), (31, junk), (31, prose(80))]
    made = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stayed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_quality(spark, made, labels_path).collect()]
    assert sorted(stayed, key=str) == sorted(((i, t) for i, t in rows if "@" not in t), key=str)

    changed = lambda t, w: " ".join([*t.split()[:-1], w])
    other = prose(80)
    rows = [(1, good), (None, changed(good, "x")), (2, changed(good, "y")), (2, other), (None, changed(other, "z")), (None, "")]
    rows += [(7, prose(80)), (None, prose(80)), (None, None), (3, "alone")]
    made = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], made.schema)
    stayed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, made, "").collect()]
    assert sorted(stayed, key=str) == sorted([rows[0], rows[3], *rows[5:]], key=str)


def brute_mix(rows):
    """{row: copies} for rows (doc_id, text, source) with ids of their own, by the written rules."""
    size = {k: len(re.findall(mixing.WORD, t or "")) for k, t, _ in rows}
    sources = collections.Counter()
    for k, _, s in rows:
        sources[s] += size[k]
    goal = filled(dict(sources))
    turns, out = mixing.ROTATIONS, {}
    for s in sources:
        rate = goal[s] / sources[s] if sources[s] else 0.0
        whole, part = int(rate), int((rate - int(rate)) * 2**32)
        mine = [k for k, _, x in rows if x == s]
        first = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) for k in mine}
        tries = [{k: whole + ((first[k] + t * (2**32 // turns)) % 2**32 < part) for k in mine} for t in range(turns)]
        out |= min(tries, key=lambda c: abs(sum(size[k] * n for k, n in c.items()) - goal[s]))  # the first of the nearest
    return out


def test_pipeline_against_brute_force(spark, tokenizer):
    """Every stage on what the one before kept, then run() as a whole."""
    rng = np.random.default_rng(21)
    lex = ["alpha", "river", "stone", "morning", "quiet", "harbour", "winter", "letter", "garden", "window", "market", "story", "evening", "bridge", "teacher"]
    text = lambda n: " ".join(rng.choice(lex, n)) + "."
    good = [text(int(rng.integers(60, 200))) for _ in range(60)]
    junk = [" ".join(rng.choice(["@@", "##", "$1", "%%%", "7", "&&", "!!"], 40)) for _ in range(25)]
    near = [t.replace(t.split()[5], "changed", 1) for t in good[:8]]
    rows = [(k, t) for k, t in enumerate(good + junk)] + [(200 + k, t) for k, t in enumerate(near)] + [(300 + k, t.replace(" ", "  \n", 2)) for k, t in enumerate(good[4:12])]
    rows += [(400, text(3000)), (401, None)]
    made = [(k, t, ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4], None, "clash") for k, t in rows]
    folder = workspace.folder(spark, "test-pipeline")
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, keep string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(85) if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    text_of, source_of = dict(rows), {k: ("a", "b", "c", None)[k % 4] for k, _ in rows}

    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        now = workspace.keep(stage(spark, now, folder), "test-stage")
        kept.append(now.select("doc_id").collect() if name != "best-fit packing" else now.collect())
        assert name == "best-fit packing" or now.columns == list(corpus_pipeline.COLUMNS)
    judged = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    first = sorted(r["doc_id"] for r in judged if r["keep"])
    assert [sorted(r[0] for r in x) for x in kept[:1]] == [first] and not set(first) & set(range(60, 85)) and set(range(60)) <= set(first)

    groups = collections.defaultdict(list)
    for k in first:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text_of[k] or "")].append(k)
    second = sorted(min(g) for g in groups.values())
    assert sorted(r[0] for r in kept[1]) == second and not set(second) & set(range(300, 308))

    sets, third = {k: shingles(text_of[k]) for k in second}, set(second)
    for k in second:  # links here are between a document and its one near copy
        third -= {j for j in second if j > k and sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])}
    assert sorted(r[0] for r in kept[2]) == sorted(third) and len(third) < len(second)

    copies = brute_mix([(k, text_of[k], source_of[k]) for k in sorted(third)])
    fourth = sorted(k for k, n in copies.items() for _ in range(n))
    assert sorted(r[0] for r in kept[3]) == fourth

    want = collections.Counter()
    for k in fourth:
        ids = ids_of(tokenizer, text_of[k]) + [1]
        want.update((k, j // 4096, j, len(ids[j : j + 4096]), crc(ids[j : j + 4096])) for j in range(0, len(ids), 4096))
    for result in (kept[4], corpus_pipeline.run(spark, folder).collect()):
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == want
        ends = collections.defaultdict(list)
        for r in result:
            ends[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in ends.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:j]) for j in range(len(pieces))] and sum(n for _, n in pieces) <= 4096
        assert len(ends) <= -(-sum(n for p in ends.values() for _, n in p) // 4096) + 2


def test_arrow_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 2000, 1, 1).select(F.lpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    found = [r["n"] for r in workspace.keep(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) >= 20_000_000 and max(found) <= 2 * workspace.BATCH_BYTES
