"""Operators against brute force, exact round trips and held-out labels."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from goldweave.llm import idfile, licenses, mixing, packing, setsketch, textvec, tiff, tokens, transcripts, voronoi
from goldweave.llm.base import tokenizer_path
from goldweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name, sf=SF):
    return QUERIES[name](spark, sf).collect()


STRANGE = ["", " ", "a", " a b", "a  b", "a\nb", "a \n b", "a\n\n b", "it's we'll I'D don't", "Ünï cöde Straße ĳ ǅ ² ½ x²y Σας ΣΑΣ", "x_y __ 12ab", "é Éte á", "<|endoftext|> a", "a<|endoftext|>", "<|startoftext|>Ab <|endoftext|><|endoftext|> C", "<|ENDOFTEXT|>", "İstanbul I", "a\x1cb c\x1d d", "日本語 テスト", "a\tb \tc\r\n d", "trail  ", "a\x85b c \x85 d", "🙂 a🙂b 'sx 's", "０１２ ٣b", "a\xa0 b\xa0c", "x'.s'. a..'s", "1,234.5%"]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_encoding_is_the_librarys(docs, name, kind):
    enc = tokens.Encoder(tokenizer_path(name), kind)
    texts = STRANGE + [d[1] for d in docs]
    ids, n = enc.encode(texts)
    whole = [Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)][0]
    whole = [e.ids for e in whole]
    assert n.tolist() == [len(w) for w in whole]
    assert ids.tolist() == list(itertools.chain(*whole))


@pytest.mark.parametrize("how", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (32, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(how, predictor, tile, order):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (33, 50), dtype=np.uint8), np.zeros((200, 48), np.uint8), np.repeat(rng.integers(0, 4, (90, 30), dtype=np.uint8), 3, axis=1)]
    data = tiff.write_tiff(pages, how, predictor, rows=10, tile=tile, order=order)
    found = list(tiff.read_pages(data))
    assert [p["page"] for p in found] == [0, 1, 2]
    assert all((p["pixels"] == q).all() and p["compression"] == how and p["tiled"] == bool(tile) for p, q in zip(found, pages))


def test_long_lzw_and_packbits():
    raw = bytes(np.random.default_rng(1).integers(0, 9, 70_000, dtype=np.uint8))
    assert tiff.unpack_lzw(tiff.pack_lzw(raw)) == raw
    assert tiff.unpack_bits(tiff.pack_bits(raw)) == raw


def test_broken_tiff_is_a_row_with_an_error(spark):
    good = tiff.write_tiff([np.zeros((2, 3), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"nonsense")), (3, None), (4, bytearray(good[:-30]))], "id int, image binary")
    found = {r.id: (r.page, r.error is None) for r in tiff.tiff_pages(df, "image", ["id"]).collect()}
    assert found[1] == (0, True) and found[2] == (-1, False) and found[4] == (-1, False) and 3 not in found


def test_stored_texts(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op3_media")}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))


def test_id_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 3, 4, 5, 1000, 70_000):
        ids = (rng.zipf(1.2, n) % 4_000_000).astype(np.uint32)
        lengths = np.array([n // 3, n - n // 3])
        import io

        got, sizes = next(idfile.blocks(io.BytesIO(idfile.encode_block(ids, lengths))))
        assert (got == ids).all() and (sizes == lengths).all()


def test_token_files_hold_all_ids(spark, docs):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start = 0
    found = sorted(rows(spark, "op4_token_ids"))
    assert len(found) == len(docs)
    for r, (i, text, *_) in zip(found, docs):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def _fewest_bins(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_dual_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(3)
    tight = 0
    for _ in range(60):
        items = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        x, n = np.unique(items, return_counts=True)
        bound, best = packing.dual_bound(x, n, 20), _fewest_bins(items, 20)
        assert bound <= best
        tight += bound == best
    assert tight > 50


def test_packed_sequences_are_whole(spark, docs):
    found = rows(spark, "op5_packing")
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    total = 0
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, text, *_ in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces] == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    for group in by_bin.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_bin) == -(-total // 4096)


def _pieces(spark, lengths):
    return spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "nr bigint, piece int, length bigint")


def _filled(packed, capacity):
    """Filled tokens of each bin, after looking at every place."""
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r.bin].append((r.place, r.length))
    for items in bins.values():
        at = 0
        for place, n in sorted(items):
            assert place == at
            at += n
        assert at <= capacity
    return {b: sum(n for _, n in items) for b, items in bins.items()}


def test_exchange_between_partitions_joins_gaps(spark):
    lengths = np.array([1 + (i * 37) % 97 for i in range(600)])
    alone = len(packing.best_fit_decreasing(lengths, 100)[2])
    log = []
    sizes = _filled(packing.pack_pieces(_pieces(spark, lengths), 100, per_partition=50, log=log), 100)
    assert sum(sizes.values()) == lengths.sum()
    assert packing.dual_bound(*np.unique(lengths, return_counts=True), 100) <= len(sizes) <= alone * 1.03
    assert len(log) > 1 and [r["bins"] for r in log] == sorted((r["bins"] for r in log), reverse=True)
    assert log[-1]["bins"] == len(sizes) and all(r["partitions"] >= s["partitions"] for r, s in zip(log, log[1:]))


def test_certified_partitions_keep_their_bins(spark):
    """Pieces of one token fill every bin, so each partition meets its bound; their last bins meet in the second round."""
    log = []
    sizes = _filled(packing.pack_pieces(_pieces(spark, [1] * 2000), 64, per_partition=100, log=log), 64)
    assert log[0]["certified"] == log[0]["partitions"] == 20 and log[0]["offered"] <= 20
    assert len(sizes) == log[-1]["bins"] == log[-1]["bound"] == -(-2000 // 64)


def test_exchange_that_gains_nothing_is_not_kept(spark):
    """Three of any pieces over a third of the room don't share a bin: certified at once, nothing to gain."""
    log = []
    sizes = _filled(packing.pack_pieces(_pieces(spark, [60] * 200), 100, per_partition=20, log=log), 100)
    assert len(sizes) == 200 == log[0]["bound"] and len(log) == 1
    rng = np.random.default_rng(4)
    lengths = rng.integers(30, 60, 400)
    log = []
    sizes = _filled(packing.pack_pieces(_pieces(spark, lengths), 100, per_partition=40, log=log), 100)
    assert len(sizes) == log[-1]["bins"] <= log[0]["bins"]


def test_languages_of_held_out_documents(spark):
    found = {r.doc_id: r for r in rows(spark, "op1_language", "/root/testdata/sf0.01")}
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = [i for i, r in found.items() if r.held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in found.items())
    assert np.mean([found[i].lang_pred == lang[i] for i in out]) > 0.97


def test_toxic_documents_are_found(spark):
    found = {r.doc_id: r.is_toxic for r in rows(spark, "op2_toxicity", "/root/testdata/sf0.01")}
    label = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert np.mean([found[i] for i, t in label if t]) > 0.6  # some are labelled without a sign
    assert np.mean([found[i] for i, t in label if not t]) < 0.03


def test_licences_by_brute_force(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op7_licenses")}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text, *_ in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        at = [(j, label) for phrase, label in licenses.PHRASES.items() for q in [phrase.split()] for j in range(len(words)) if words[j : j + len(q)] == q]
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_template_with_words_put_in_is_found(spark):
    text = "x " * 20 + "Permission is hereby granted, free of charge, to any nice person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"
    df = spark.createDataFrame([(1, text), (2, "permission is hereby granted"), (3, None)], "doc_id bigint, text string")
    got = {r.key: r for r in licenses.scan(df, "doc_id", "text").collect()}
    assert got[1].labels == "mit" and 0.75 <= got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == "" and got[3].n_words == 0


def _brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(4000)]
    texts, k = {}, 0
    for family in range(12):
        base = rng.choice(vocab, rng.integers(30, 200)).tolist()
        for _ in range(int(rng.integers(1, 25))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(1 << 30)}"
            texts[k] = " ".join(copy)
            k += 1
            if rng.random() < 0.3:
                base = copy  # chains: ends may be far apart
    texts |= {k: "", k + 1: "one two", k + 2: "One  TWO", k + 3: "one two three"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op8_near_duplicates", str(tmp_path))}
    want = _brute_groups(texts)
    assert got == want


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(8)
    a, b = (textvec.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (500, 300))
    one = setsketch.registers(np.concatenate([a, b, np.concatenate([a, b])]), np.array([0, 500, 800, 1600]))
    assert (np.maximum(one[0], one[1]) == one[2]).all()
    x, y = one[0], one[2]
    guess, may = setsketch.likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([500.0]), np.array([800.0]), 0.75)
    assert abs(guess[0] - 500 / 800) < 0.12


def test_mixing_draws_poisson_counts(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS source")
    got = mixing.mix_sources(df, targets={"a": 0.5, "b": 0.5})
    by = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(by["a"] / by["b"] - 1) < 0.06
    counts = collections.Counter(r["count"] for r in got.filter("source = 'a'").groupBy("doc_id").count().collect())
    assert abs(counts[1] / 5000 - 2 * np.exp(-2)) < 0.03
    assert got.orderBy("__order").count() == got.count()


def test_poisson_of_any_mean_is_inverted(spark):
    """Against sums of the terms by logarithms of the gamma function, below and beyond the change of method."""
    import math

    means = [1e-6, 0.3, 7.5, 499.9, 500.1, 740.0, 3000.25, 40_000.0]
    us = [0.0, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(m, u) for m in means for u in us], "m double, u double")
    got = {(r.m, r.u): r.k for r in df.withColumn("k", mixing.poisson_count(F.col("u"), mixing.poisson_steps(F.col("m")))).collect()}
    for m in means:
        low = max(0, int(m - 12 * m**0.5))
        c = np.cumsum([math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(low, int(m + 12 * m**0.5 + 40))])
        for u in us[1:]:
            assert abs(got[m, u] - (low + int(np.searchsorted(c, u, "right")))) <= (u > 0.9999), (m, u)


def test_repeated_rows_are_mixed_alike_and_spread(spark):
    df = spark.createDataFrame([(7, "same", "a")] * 3000, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df, targets={"a": 1.0})
    assert got.count() % 3000 == 0 and got.select("__order").distinct().count() == got.count()


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = con.sql(sql)
        cols = sorted(want.columns)
        got = QUERIES[name](spark, SF).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), name


def test_knn_of_blocks_and_hot_vectors_by_brute_force(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-50, 50, (700, 6))
    v[200:500] = v[200]
    data = spark.createDataFrame([(i, x.astype(float).tolist()) for i, x in enumerate(v)], "key bigint, v array<double>")
    got = collections.defaultdict(list)
    for r in voronoi.top_k(data, data.filter("key % 50 = 0"), 7, pivots=9, block=64, per_group=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 700, 50):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(700) if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]


def test_scores_beyond_doubles_are_exact():
    q = np.array([[(1 << 40) + 1.0, 3]])
    x = np.array([[(1 << 20) + 1.0, 5], [1 << 40, 1 << 40]])
    got = voronoi.exact_scores(q, x)
    assert voronoi.exact_scores(q * 2.0**90, -x)[0].tolist() == [-(1 << 63)] * 2
    assert got[0, 0] == ((1 << 40) + 1) * ((1 << 20) + 1) + 15 and got[0, 1] == (1 << 63) - 1


def _random_model(rng):
    return transcripts.Model(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), [np.log(rng.dirichlet(np.ones(n), 6)) for n in transcripts.SIZES])


def _log_probability(model, x, path):
    e = transcripts.emissions(model, x)
    return model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(e[i, s] for i, s in enumerate(path))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(11)
    for n in (1, 2, 5):
        model = _random_model(rng)
        x = np.stack([rng.integers(0, k, n) for k in transcripts.SIZES], axis=1)
        best = max(itertools.product(range(6), repeat=n), key=lambda p: _log_probability(model, x, p))
        assert transcripts.viterbi(model, x, np.array([0, n]), np.array([-1]), np.array([-1])).tolist() == list(best)


def test_many_chunks_at_a_time_and_chains_are_viterbi():
    rng = np.random.default_rng(10)
    model = _random_model(rng)
    x = np.stack([rng.integers(0, n, 500) for n in transcripts.SIZES], axis=1)
    none = lambda n: np.full(n, -1)
    starts = np.array([0, 37, 38, 200, 333, 500])
    together = transcripts.viterbi(model, x, starts, none(5), none(5))
    apart = [transcripts.viterbi(model, x[a:b], np.array([0, b - a]), none(1), none(1)) for a, b in zip(starts, starts[1:])]
    assert (together == np.concatenate(apart)).all()
    enters, leaves = transcripts.chain([transcripts.summary(model, x[a:b], i == 0) for i, (a, b) in enumerate(zip(starts, starts[1:]))])
    path = transcripts.viterbi(model, x, starts, np.array(enters), np.array(leaves))
    assert (path == transcripts.viterbi(model, x, np.array([0, 500]), none(1), none(1))).all()


def _parsed(spark, rows, model, chunk=4096):
    df = spark.createDataFrame(rows, "c bigint, i bigint, t string")
    return sorted(map(tuple, transcripts.turns(transcripts.read_lines(df, "c", ["i"], "t", chunk=chunk), model).collect()), key=str)


def test_roles_of_held_out_conversations(spark):
    got = {(r.conv_id, r.turn): r for r in rows(spark, "op9_chat")}
    truth = duckdb.sql(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role FROM '{SF}/conversations.parquet'").fetchall()
    held = [(got[c, t].role, role) for c, t, role in truth if (c, t) in got and got[c, t].held_out]
    assert len(got) == len(truth) and np.mean([a == b for a, b in held]) > 0.9


def test_long_conversations_in_small_chunks_and_many_tasks_are_the_same(spark):
    """Blank lines, turns and states go over the borders of chunks and of tasks; the text is that of a plain reader."""
    rng = np.random.default_rng(12)
    lines = []
    for c in (5, (1 << 60) + 1, (1 << 60) + 3, None):
        said = []
        for k in range(60):
            said += [("User: " if k % 2 == 0 else "Assistant: ") + f"words {k}?"] + [("", f"more {k}")[int(b)] for b in rng.integers(0, 2, int(rng.integers(0, 5)))] + [""] * int(rng.integers(1, 4))
        lines += [(c, i, t) for i, t in enumerate(said)]
    known, role = [], 0
    for c, i, t in lines:
        role = 4 if t.startswith("Assistant") else 2 if t.startswith("User") else role
        known.append((c, i, t, role + (": " not in t)))
    df = spark.createDataFrame(known, "c bigint, i bigint, t string, s int")
    model = transcripts.fit(transcripts.read_lines(df, "c", ["i"], "t", F.col("s")))
    whole = _parsed(spark, lines, model)
    assert {r[0] for r in whole} == {5, (1 << 60) + 1, (1 << 60) + 3, None}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert _parsed(spark, lines, model, chunk=7) == whole
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    for c in (5, None):  # a turn begins at each marker here: its text is all lines up to the next, without blank ones at the ends
        want, now = [], None
        for _, _, t in (r for r in lines if r[0] == c):
            if ": " in t:
                now = [t.split(": ", 1)[1]]
                want.append(now)
            else:
                now.append(t)
        texts = [r[4] for r in sorted((r for r in whole if r[0] == c), key=lambda r: r[1])]
        assert texts == ["\n".join(w).rstrip("\n") for w in want]
        assert [r[5] for r in whole if r[0] == c and r[1] == 0] == [f"<|user|>\n{texts[0]}\n<|end|>\n"]


def test_counts_of_the_model_are_those_of_a_plain_reader(spark):
    df = spark.createDataFrame([(c, i, t, s) for c in range(4) for i, (t, s) in enumerate([("System: x", 0), ("", None), ("User: why?", 2), ("more", 3), (" ", None), ("AI: so", 4), ("odd", None), ("then", 5)])], "c bigint, i bigint, t string, s int")
    model = transcripts.fit(transcripts.read_lines(df, "c", ["i"], "t", F.col("s")))
    start, move = np.ones(6), np.ones((6, 6))
    start[0] += 4
    for a, b in ((0, 2), (2, 3), (3, 4)):  # the unlabelled line parts 4 and 5
        move[a, b] += 4
    assert np.allclose(np.exp(model.start), start / start.sum()) and np.allclose(np.exp(model.move), move / move.sum(axis=1, keepdims=True))
    assert np.allclose(np.exp(model.emit[1][4]), np.array([1, 5]) / 6)  # after a gap
