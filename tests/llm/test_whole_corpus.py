"""What bounds on learning must not lose: rare categories, many languages, borders of chunks, large vectors."""

import duckdb
import numpy as np

from goldweave.llm import langid, setsketch, toxicity
from goldweave.llm.queries import QUERIES


def test_toxic_documents_are_found_by_few_labels(spark):
    for folder, least in (("sf0.01", 0.7), ("sf0.001", 0.6)):
        label = duckdb.sql(f"SELECT doc_id, toxic FROM '/root/testdata/{folder}/labels.parquet'").fetchall()
        found = {r.doc_id: r.is_toxic for r in QUERIES["op2_toxicity"](spark, f"/root/testdata/{folder}").collect()}
        assert np.mean([found[i] for i, t in label if t]) > least
        assert np.mean([found[i] for i, t in label if not t]) < 0.03


def test_threshold_without_a_precise_cut():
    y = np.array([0, 1, 0, 1] + [0] * 16, float)
    p = np.linspace(0.9, 0.1, 20)
    cut = toxicity.best_threshold(p, y)
    assert p[4] < cut < p[3]
    assert toxicity.best_threshold(np.full(20, 0.5), y) == 2  # nothing tells the category


def test_rare_labels_are_all_drawn(spark):
    assert toxicity.rates([10, 0, 1000, 5000], 210) == [1.0, 0.0, 0.1, 0.02]
    n = 4000
    docs = spark.createDataFrame([(i, f"clean words number {i}" + (" vile insult" if i % 100 == 0 else "")) for i in range(n)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(n)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, ["toxic"], most=80)
    found = {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).filter("is_toxic").collect()}
    assert found == set(range(0, n, 100))


def test_every_language_is_learned(spark):
    """150 languages of words of their own: three slices of masks."""
    rng = np.random.default_rng(1)
    words = {f"l{k:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(30)] for k in range(150)}
    rows = [(100 * k + i, " ".join(rng.choice(w, 40)), name) for k, (name, w) in enumerate(words.items()) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert sorted(model.languages) == sorted(words) and model.slots.shape[0] == 3
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert all(found[i][0] == name and found[i][1] > 0.3 for i, _, name in rows)
    assert docs.filter(langid.accepts(docs, model, "text", 0.2)).count() == len(rows)


def test_pairs_within_fourteen_are_not_ruled_out():
    apart = np.arange(0, 80, 2)
    more = less = apart / 2
    sizes = np.full(len(apart), 1000.0)
    kept = {s: setsketch.likely(more, less, 160 - apart, sizes, sizes, 0.75, s)[1] for s in (10.0, 14.0)}
    assert (kept[14.0] & ~kept[10.0]).any()
    assert (setsketch.likely(more, less, 160 - apart, sizes, sizes, 0.75)[1] == kept[14.0]).all()
