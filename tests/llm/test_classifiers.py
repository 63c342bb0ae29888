import numpy as np
import pytest
import zstandard as zs
from pyspark.sql import functions as F
from quire.llm import langid, quality, toxicity
from quire.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(tables):
    docs, labels = tables
    scored = quality.classify(docs, labels, ~held_out("doc_id", 3, 1)).join(labels, "doc_id").where(held_out("doc_id", 3, 1))
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_accepted_rows_are_those_predicted(tables):
    docs, labels = tables
    learn = ~held_out("doc_id", 3, 1)
    good = quality.classify(docs, labels, learn).where("predicted = 1").select("doc_id").collect()
    kept = quality.accepted(docs, labels, learn)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.select("doc_id").collect())) == sorted(map(tuple, good))


def test_discriminant_is_the_densities_ratio():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (300, 3))
    m = quality.Discriminant.of_sums(np.array([500, 300]), np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]), 0.1, 0.2)
    x = rng.normal(0, 2, (20, 3))
    log = []
    for own, n in ((a, 500), (b, 300)):
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.2 * np.eye(3)
        d = x - own.mean(0)
        log.append(np.log(n / 800) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_fit_counts_labels_as_often_as_they_occur(spark):
    texts = {1: "some plain words here", 2: "more words, 12 of them!", 3: None, 4: "not labelled"}
    marks = [(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None), (2, 2)]
    docs = spark.createDataFrame([*texts.items(), (2, "a second text of 2"), (None, "no id")], "doc_id long, text string")
    made = quality._sums(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True), "quality", "doc_id", "text")
    got = np.zeros((2, 1 + (d := len(quality.NAMES)) + d * d))
    for r in made.collect():
        got.ravel()[r.at] += r.value
    for k in (0, 1):
        x = np.array([quality.statistics(t) for i, label in marks if i is not None and label == k for t in [texts[i], *["a second text of 2"] * (i == 2)]])
        assert np.allclose(got[k], np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))


def test_language_held_out(tables):
    docs, _ = tables
    model = langid.train(docs, ~held_out("doc_id", 3, 1))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 3, 1))
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_language_families():
    model = langid.Model.fit(np.stack([langid.grams(t) for t in ("the house and", "das haus und", "la maison et", "la casa y", "дом и")]), ["en", "de", "fr", "es", "xx"])
    assert set(model.members) == {"germanic", "romance", "xx"} and set(model.pair) == {("de", "en"), ("es", "fr")}
    assert model.predict("und das haus")[0] == "de" and model.predict("123 !")[0] == "und" and model.predict(None) == ("und", 0.0)


def test_copies_weigh_like_one_text():
    copied = "rareone raretwo rarethree raretfour plain words"
    toxic = [copied] * 20 + [f"nasty{c} some plain words {c}x{c}y" for c in "abcdefghijklmnop"]
    ordinary = [f"some plain words {c}z{c}w" for c in "abcdefghijklmnopqrstuvwxyz"]
    marked = toxicity.toxic_windows(toxicity.fresh_windows(toxic), toxicity.fresh_windows(ordinary))
    assert len(marked) == 16 and all(w.startswith(b"nasty") for w in marked)


def test_distance_is_that_of_plain_calls():
    """Each window by itself, by one plain call for each dictionary; counts of differences from these."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["ba", "ko", "li", "mu", "ré", "so"], rng.integers(1, 5)))
    good = [" ".join(word() for _ in range(200)) for _ in range(40)]
    bad = [f"{t} wretched{word()} {word()} horrible" for t in good]
    model = toxicity.Model.fit(bad, good, 0.5)
    tools = []
    for raw in (model.distance.ordinary, model.distance.toxic):
        params = zs.ZstdCompressionParameters.from_level(19, strategy=zs.STRATEGY_BTLAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        tools.append(zs.ZstdCompressor(dict_data=known, compression_params=params))
    texts = [good[0], bad[1], "", None, "horrible", "One HORRIBLE wretched thing", " ".join(good)]
    for text, row, step in [(t, r, k) for k in (2, 1) for t, r in zip(texts, model.distance.features(texts, k), strict=True)]:
        words = (text or "").lower().encode().split()
        wins = [b" ".join(words[i : i + 2]) for i in range(0, len(words), step)]
        if step == 1 and len(words) > 1:
            wins.pop()  # the last word is in the run before
        diffs = [len(tools[0].compress((b"\n " + w + b" ") * 2)) - len(tools[1].compress((b"\n " + w + b" ") * 2)) for w in wins]
        over = [sum(d >= t for d in diffs) for t in range(3, 9)]
        assert np.allclose(row, np.append(np.log1p([*over, len(wins) if over[0] else 0]), 1))
    scores = model.score(texts)
    assert scores[1] > 0.5 > scores[0] and scores[2] == scores[3] < 0.3
    assert np.allclose(scores, [model.score([t])[0] for t in texts])  # however the texts are put together


def test_toxicity_finds_words(spark):
    rng = np.random.default_rng(1)
    syllables = ["ba", "ko", "li", "mu", "re", "so", "ta", "vi", "ne", "du"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.integers(5, 80))]
        bad = i % 5 == 0
        if bad:
            for w in rng.choice(["disgraceful", "horrible", "wretched"], 2):
                words.insert(int(rng.integers(0, len(words))), str(w))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = held_out("doc_id", 4, 2)
    got = toxicity.score(d, toxicity.train(d, y, ~held)).join(y, "doc_id").where(held)
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95


def test_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    learn = ~held_out("doc_id", 3, 7)
    for docs, n in ((odd, odd.count()), (empty, 0)):
        for y in (labels, none):
            assert quality.classify(docs, y, learn).count() == n
            assert quality.accepted(docs, y, learn).columns == docs.columns
            scored = toxicity.score(docs, toxicity.train(docs, y, learn))
            assert scored.where("score between 0 and 1").count() == n
        said = langid.identify(docs, langid.train(docs, learn))
        assert said.count() == n
        assert said.where("doc_id in (3, 4, 5) and lang_pred <> 'und'").count() == 0
    assert {r.score for r in quality.classify(odd, none, learn).collect()} == {0.5}
