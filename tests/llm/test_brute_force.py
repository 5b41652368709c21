"""Operators beside plain models of their own, other readers of the same format, and ids of any size."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from goldweave.llm import langid, neardup, op3, tiff, toxicity
from goldweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BIG = 1 << 60


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Ids that a double can't hold, beside null ones and repeated rows, in one file each."""
    out = str(tmp_path_factory.mktemp("big"))
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    docs = [(BIG + 1, words(1)), (None, words(2)), (BIG + 3, words(3)), (BIG + 1, words(1)), (None, None), (BIG + 5, words(3)), (BIG + 7, words(4)), (-BIG - 1, words(5))]
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(BIG + 1, 1, 0), (None, 1, 1), (BIG + 3, 0, 1)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{out}/labels.parquet")
    turns = [(c, t, r, f"{r} of {n}") for n, c in enumerate((BIG + 1, None, BIG + 3)) for t, r in enumerate(("user", "assistant"))]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{out}/conversations.parquet")
    k = BIG // 100 * 100
    spark.createDataFrame([(k, [1.0, 2.0]), (None, [9.0, 9.0]), (k + 1, [2.0, 1.0]), (k + 3, [3.0, 1.0])], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return out


IDS = sorted([BIG + 1, None, BIG + 3, BIG + 1, None, BIG + 5, BIG + 7, -BIG - 1], key=str)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op8")])
def test_ids_beyond_doubles_stay_whole(spark, big, name):
    assert sorted((r.doc_id for r in QUERIES[name](spark, big).collect()), key=str) == IDS


def test_groups_of_ids_beyond_doubles(spark, big):
    found = {r.doc_id: (r.component_id, r.kept) for r in QUERIES["op8_near_duplicates"](spark, big).collect()}
    assert found == {BIG + 1: (BIG + 1, True), BIG + 3: (BIG + 3, True), BIG + 5: (BIG + 3, False), BIG + 7: (BIG + 7, True), -BIG - 1: (-BIG - 1, True), None: (None, True)}


def test_conversations_and_copies_and_vectors_of_ids_beyond_doubles(spark, big):
    turns = collections.Counter(r.conv_id for r in QUERIES["op9_chat"](spark, big).collect())
    assert turns == {BIG + 1: 2, BIG + 3: 2, None: 2}
    assert set(r.doc_id for r in QUERIES["op6_mixing"](spark, big).collect()) <= set(IDS)
    k = BIG // 100 * 100
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op10_knn"](spark, big).collect()] == [(k, 1, k + 3, 5 << 20), (k, 2, k + 1, 4 << 20)]


def _plain_grams(text):
    """5 bytes at every place of the lower-cased letters, words apart by one blank and the text's end by two."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    raw = re.sub(rb" +", b" ", b" " + raw + b" ") + b" "
    return [raw[i : i + 5] for i in range(len(raw) - 4)]


def test_languages_by_plain_sets(spark):
    """Sets of n-grams instead of a filter: the same languages, and scores within the filter's chance."""
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' WHERE length(text) > 10").fetchall()
    known = [(t, g) for i, t, g in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame(known, "text string, lang string")
    model = langid.fit(df)
    size = collections.Counter(g for _, g in known)
    seen = collections.Counter((x, g) for t, g in known for x in set(_plain_grams(t)))
    rates = collections.defaultdict(dict)
    for (x, g), n in seen.items():
        rates[x][g] = n / size[g]
    own = {x: {g for g, r in by.items() if r >= 0.25 * max(by.values())} for x, by in rates.items() if sum(seen[x, g] for g in by) >= 3}
    order = sorted(size, key=lambda g: (-size[g], g))
    assert model.languages == order
    names, scores = model.predict([t for _, t, _ in docs])
    for (i, t, _), name, score in zip(docs, names, scores):
        got = _plain_grams(t)
        share = {g: sum(g in own.get(x, ()) for x in got) / max(1, len(got)) for g in order}
        best = max(order, key=lambda g: share[g])
        assert abs(score - share[best]) < 0.03 and share[name] > share[best] - 0.03, i
        assert name == best or abs(share[name] - share[best]) < 0.03


def test_linear_models_are_the_optimum():
    """Against Newton's method on the dense matrix."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    before = rng.random((300, 1))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12) * 2 + before[:, 0] - 1)))).astype(float)
    at, starts = np.concatenate([np.flatnonzero(r) for r in x]), np.append(0, np.cumsum(x.sum(axis=1).astype(int)))
    m = toxicity.train(at, starts, before, y, 12, steps=200)
    z = np.hstack([x, before, np.ones((300, 1))])
    ridge = np.diag([toxicity.L2] * 13 + [0.0])
    t = np.zeros(14)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ t))
        t -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ t)
    assert np.allclose([*m.weights, *m.extra, m.bias], t, atol=5e-3)


def test_chain_by_plain_sums(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 200").fetchall()
    from goldweave.llm.base import documents, table
    from goldweave.llm.op2 import learn

    model = learn(documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels"))
    place = {int(k): i for i, k in enumerate(model.keys)}
    got = model.predict([t for _, t in docs])
    for (_, t), p in zip(docs, got):
        own = {place[k] for k in map(int, toxicity.occurrences([t])[0]) if k in place}
        before = []
        for c, m in enumerate(model.models):
            z = m.bias + sum(m.weights[i] for i in own) + sum(a * b for a, b in zip(m.extra, before))
            before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            assert before[-1] == pytest.approx(p[c], abs=1e-9)


def test_labels_without_a_sign_flag_nothing(spark):
    """Out of fold means out of the choice of features, too: of chance labels no cut looks good."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"q{k}" for k in rng.integers(0, 400, 60))) for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(rng.integers(0, 2, 500))], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, ["toxic"])
    assert toxicity.score(docs, model, ["doc_id"]).filter("is_toxic").count() < 50


def test_stored_texts_in_all_columns(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = {r.doc_id: r for r in QUERIES["op3_media"](spark, SF).collect()}
    forms = set()
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        how = op3.FORMS[zlib.crc32(raw) % len(op3.FORMS)]
        forms.add(str(how))
        rows = np.frombuffer(payload, np.uint8).reshape(-1, 192)
        stored = tiff.write_tiff([rows[y : y + op3.PAGE_ROWS] for y in range(0, len(rows), op3.PAGE_ROWS)], **how)
        n = collections.Counter(payload)
        entropy = -sum(c / len(payload) * np.log2(c / len(payload)) for c in n.values())
        feature = f"rows={len(rows)};mean={sum(payload) / len(payload):.3f};levels={len(n)};entropy={entropy:.3f}"
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, -(-len(rows) // op3.PAGE_ROWS))
        assert tuple(found[i]) == want
    assert len(forms) >= 6 and any(r.pages > 1 for r in found.values())


def test_packbits_of_the_published_example():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(packed) == plain and tiff.unpack_bits(tiff.pack_bits(plain)) == plain


def test_lzw_of_the_specifications_example():
    plain, codes = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.pack_lzw(plain) == packed and tiff.unpack_lzw(packed) == plain


def _java_pixels(jvm, path, page):
    stream = jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.File(path))
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff").next()
    reader.setInput(stream)
    raster = reader.read(page).getData()
    stream.close()
    return bytes(raster.getDataBuffer().getData())


@pytest.mark.parametrize("how", [{"compression": c, "predictor": 1, "order": o} for c in ("none", "packbits", "lzw", "deflate") for o in "<>"] + [{"compression": "lzw", "order": ">"}, {"compression": "deflate"}, {"compression": "packbits", "predictor": 1, "tile": (64, 16)}, {"compression": "lzw", "tile": (64, 32)}, {"compression": "deflate", "tile": (96, 64)}])
def test_another_reader_sees_the_same_pages(spark, tmp_path, how):
    """The TIFF reader of the Java platform, which shares no code with this one."""
    rng = np.random.default_rng(6)
    pages = [rng.integers(97, 123, (150, 192), dtype=np.uint8), np.repeat(rng.integers(0, 256, (40, 12), dtype=np.uint8), 16, axis=1)]
    path = f"{tmp_path}/a.tiff"
    with open(path, "wb") as f:
        f.write(tiff.write_tiff(pages, **{"predictor": 2} | how))
    for k, p in enumerate(pages):
        assert _java_pixels(spark._jvm, path, k) == p.tobytes()


@pytest.mark.parametrize("kind", ["PackBits", "LZW", "Deflate", "ZLib"])
def test_pages_of_another_writer_are_read(spark, tmp_path, kind):
    jvm = spark._jvm
    rng = np.random.default_rng(7)
    pixels = rng.integers(97, 123, (90, 200), dtype=np.uint8)
    image = jvm.java.awt.image.BufferedImage(200, 90, 10)  # 8-bit grey
    array = spark.sparkContext._gateway.new_array(jvm.int, pixels.size)
    for i, v in enumerate(pixels.ravel().tolist()):
        array[i] = v
    image.getRaster().setPixels(0, 0, 200, 90, array)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)  # explicit
    how.setCompressionType(kind)
    path = f"{tmp_path}/b.tiff"
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    out.close()
    with open(path, "rb") as f:
        (page,) = tiff.read_pages(f.read())
    assert (page["pixels"] == pixels).all()


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


@pytest.mark.parametrize("how", [{"block": 8, "first": 1}, {"block": 8, "first": 1, "exact": True}, {"block": 50}])
def test_hot_buckets_in_many_blocks_by_brute_force(spark, how):
    """One family of copies around the threshold: many meet without being linked, in blocks of a few members."""
    rng = np.random.default_rng(13)
    vocab = [f"v{i}" for i in range(3000)]
    base = rng.choice(vocab, 120).tolist()
    texts = {}
    for k in range(140):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            copy[int(at)] = f"x{rng.integers(1 << 30)}"
        texts[k] = " ".join(copy)
    sets = {i: _shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            linked += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert 0.05 < linked / (140 * 139 / 2) < 0.8
    got = {r.key: r.component_id for r in neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **how).collect()}
    assert got == {i: find(i) for i in texts}


