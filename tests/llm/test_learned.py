"""Quality classifier, toxicity and language-model scores."""

import collections
import math
import zlib

import numpy as np
import pytest

from millrace.llm import lm_scoring, quality_classifier, toxicity, words

from .conftest import EDGES, LOWER, WORD


def held(doc_id, folds, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == rest


def test_words_equal_a_regular_expression():
    import pyarrow as pa

    got = [[] for _ in EDGES]
    for first, data, offsets in words.chunks(pa.array(EDGES)):
        w = words.Words(data, offsets)
        for d, s, n in zip(w.doc, w.start, w.length, strict=True):
            got[first + d].append(bytes(w.data[s : s + n]).decode())
    assert got == [WORD.findall((t or "").translate(LOWER)) for t in EDGES]


@pytest.mark.parametrize(("module", "label", "least"), [(quality_classifier, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(module, label, least, documents, labels):
    got = {r["doc_id"]: r for r in module.classify(documents, labels).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert all(r["held_out"] == held(i, 5, 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    own = [got[i]["predicted"] == y for i, y in truth.items() if held(i, 5, 0)]
    assert sum(own) / len(own) >= least


@pytest.mark.parametrize(("module", "label", "recall", "precision"), [(quality_classifier, "quality", 0.99, 0.99), (toxicity, "toxic", 0.88, 0.99)])
def test_held_out_recall_and_precision(spark, module, label, recall, precision):
    """On the 825 held-out labels of the largest test folder."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["predicted"] for r in module.classify(docs, marks).where("held_out").collect()}
    pairs = [(r[label], got[r["doc_id"]]) for r in marks.collect() if r["doc_id"] in got]
    hits = sum(y and p for y, p in pairs)
    assert hits >= recall * sum(y for y, _ in pairs) and hits >= precision * sum(p for _, p in pairs)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classify_edges(module, edges, empty, documents, labels, spark):
    got = module.classify(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.classify(empty, labels).count() == 0
    assert {r["score"] for r in module.classify(documents, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_teach_nothing(documents, labels, spark):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(documents, labels), quality_classifier.fit(documents, flipped)
    assert np.allclose(a.means, b.means)


def test_discriminant_is_the_posterior():
    rng = np.random.default_rng(0)
    means, cov = np.array([[0.0, 0.0], [2.0, 1.0]]), [np.array([[1.0, 0.3], [0.3, 2.0]]), np.array([[0.5, 0.0], [0.0, 0.5]])]
    lower = [np.linalg.cholesky(c) for c in cov]
    model = quality_classifier.Discriminant(means, np.array([np.linalg.inv(x) for x in lower]), np.array([math.log(0.4) - np.log(np.diag(lower[0])).sum(), math.log(0.6) - np.log(np.diag(lower[1])).sum()]))
    x = rng.standard_normal((50, 2))
    density = [p * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for p, m, c in zip((0.4, 0.6), means, cov, strict=True)]
    assert np.allclose(model.score(x), density[1] / (density[0] + density[1]))


def brute_statistics(text):
    """The statistics of one text, by its definition."""
    words_ = WORD.findall((text or "").translate(LOWER))
    raw = (text or "").encode()
    n, letters = len(words_), sum(len(w.encode()) for w in words_)
    share = lambda k, prior: math.sqrt(min(9.0, (k + 10 * prior) / (n + 10)))
    counts = [(b"#*$%&|<>", 0.0), (b"!", 0.0), (bytes(range(65, 91)), 0.1), (b"0123456789", 0.02), (b"\n", 0.02), (b".,;:?", 0.15)]
    out = [math.log1p(n), share(letters, 6.0), *[share(sum(c in of for c in raw), prior) for of, prior in counts]]
    out += [share(sum(a == b for a, b in zip(words_[lag:], words_, strict=False)), 0.01) for lag in (1, 2, 3, 4)]
    return [*out, share(sum(len(w.encode()) <= 3 for w in words_), 0.35), share(len(raw) - letters, 1.0)]


def test_statistics_and_fit_by_brute_force(documents, labels, edges):
    import pyarrow as pa

    texts = [r["text"] for r in documents.collect()] + EDGES
    got = np.concatenate([quality_classifier.statistics(data, offsets) for _, data, offsets in words.chunks(pa.array(texts))])
    assert np.allclose(got, [brute_statistics(t) for t in texts])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if not held(r["doc_id"], 5, 0)}
    x = {k: np.array([brute_statistics(r["text"]) for r in documents.collect() if truth.get(r["doc_id"]) == k]) for k in (0, 1)}
    model = quality_classifier.fit(documents, labels)
    everything = np.array([brute_statistics(t) for t in texts])
    logs = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True)
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        off = everything - x[k].mean(axis=0)
        logs.append(math.log(len(x[k])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(got), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def test_neutral_mentions_are_no_longer_found_toxic(spark):
    """Held-out neutral sentences that name a group the training texts mostly insult: false positives without and with the penalty."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    groups = [("muslims", "christians", "jews"), ("women", "men")]
    calm = "people walk by the river and read the paper while rain falls on the quiet town".split()
    rows, marks = [], []
    for i in range(1500):
        bad = int(rng.random() < 0.5)
        group = str(rng.choice(["muslims", "women"] if rng.random() < (0.8 if bad else 0.1) else ["christians", "jews", "men", "they"]))
        text = " ".join(rng.choice(calm, 12)) + f". {group} " + (f"slur{rng.integers(40)}" if bad and rng.random() < 0.6 else str(rng.choice(calm))) + ". " + " ".join(rng.choice(calm, 8))
        rows.append((i, text))
        marks.append((i, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = pa.array([f"{g} {' '.join(rng.choice(calm, 9))}" for g in ("muslims", "women") for _ in range(50)])
    insult = pa.array([f"{g} are {w} and {' '.join(rng.choice(calm, 6))}" for g in ("christians", "jews", "men", "muslims") for w in ("slur1", "slur7", "slur23")])
    table = spark.createDataFrame([(str(k), t) for k, g in enumerate(groups) for t in g] + [(None, "x"), ("9", ""), ("9", None)], "kind string, term string")
    plain, fair, from_table = toxicity.fit(docs, labels, groups=groups, fairness=0.0), toxicity.fit(docs, labels, groups=groups), toxicity.fit(docs.repartition(7), labels, groups=table)
    before, after = (plain.score(neutral) >= 0.5).sum(), (fair.score(neutral) >= 0.5).sum()
    print("false positives of 100:", before, "then", after)
    assert before >= 50 and after <= 5
    assert (fair.score(insult) >= 0.5).mean() == 1
    assert np.allclose(fair.score(neutral), from_table.score(neutral), atol=1e-6)


def test_the_regression_is_the_minimum_of_its_loss():
    """The weights against many plain gradient steps on dense matrices."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = rng.poisson(0.4, (200, 12)).astype(float)
    y = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.5, 200) > 0.5).astype(int)
    delta = np.zeros((4, 12))
    delta[[0, 1, 2, 3], [0, 0, 5, 6]], delta[[0, 1, 2, 3], [3, 4, 6, 7]] = 1, -1
    k = np.array([5, 1, 2, 2])
    lists = lambda m: [pa.array([np.flatnonzero(r).tolist() for r in m], pa.list_(pa.int64())), pa.array([r[r != 0].tolist() for r in m], pa.list_(pa.float64()))]
    rows, pairs = pa.table([pa.array(y, pa.int32()), *lists(x)], names=["y", "at", "x"]), pa.table([*lists(delta), pa.array(k)], names=["at", "x", "k"])

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE * 10 / len(y) * (w @ w) / 2 + toxicity.FAIRNESS * (k / k.sum()) @ (delta @ w) ** 2

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w = w - 0.05 * (x.T @ off + toxicity.RIDGE * 10 / len(y) * w + 2 * toxicity.FAIRNESS * delta.T @ (k / k.sum() * (delta @ w)))
        b -= 0.05 * off.sum()
    got = toxicity._regress(rows, pairs, 12, toxicity.FAIRNESS)
    assert loss(*got) <= 1.01 * loss(w, b)


def test_swaps_reduce_the_weight_of_identity_terms(spark):
    """Insults come with one group's name; a neutral mention of it must not count."""
    rows, marks = [], []
    for i in range(600):
        bad = i % 2
        text = "some plain words about the weather and the town today. "
        text += "muslims are idiots and scum. " if bad and i % 3 else "they are idiots and scum. " if bad else "people walk by the river. "
        rows.append((i, text + f"filler{i} filler{i + 1}"))
        marks.append((i, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = ["muslims walk by the river and the town today."]
    import pyarrow as pa

    fair, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, fairness=0.0)
    assert fair.score(pa.array(neutral))[0] < 0.5 and fair.score(pa.array(neutral))[0] < plain.score(pa.array(neutral))[0]
    assert fair.score(pa.array(["they are idiots and scum"]))[0] > 0.5


def test_unigram_scores_by_brute_force(documents, edges, empty):
    for docs in (documents, edges):
        for frequent in (1 << 19, 20):
            rows = docs.select("doc_id", "text").collect()
            texts = [[*WORD.findall((r["text"] or "").translate(LOWER)), None] for r in rows]
            counts = collections.Counter()
            for r, t in zip(rows, texts, strict=True):
                if not held(r["doc_id"], 7, 2):
                    counts.update(t)
            n, v = sum(counts.values()), len(counts)
            want = sorted((-1 if r["doc_id"] is None else r["doc_id"], held(r["doc_id"], 7, 2), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, texts, strict=True))
            got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm_scoring.score(docs, frequent=frequent).collect())
            assert [x[:5] for x in got] == [x[:5] for x in want]
            assert np.allclose([x[5] for x in got], [x[5] for x in want])
    assert lm_scoring.score(empty).count() == 0


def test_class_probabilities_sum_to_one_and_training_helps(documents):
    rng = np.random.default_rng(1)
    p = lm_scoring.class_probabilities(rng.standard_normal((lm_scoring._ROWS, lm_scoring.CLASSES)), rng.standard_normal(lm_scoring.CLASSES), np.arange(0, lm_scoring._CONTEXTS, 977))
    assert np.allclose(p.sum(axis=1), 1)
    trained = [r for r in lm_scoring.score(documents).collect() if r["held_out"]]
    untrained = [r for r in lm_scoring.score(documents, rounds=0).collect() if r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["score"] for r in untrained)


def test_words_of_a_class_depend_on_the_history():
    """Two words of one class, of equal counts, that only the word before tells apart; probabilities over the class sum to one."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mass = np.zeros((lm_scoring.CLASSES, lm_scoring.FAN))
    np.add.at(mass[5], (hashes % np.uint64(lm_scoring.FAN)).astype(int), 301)
    n = 2 * (lm_scoring.FAN - 1)  # of 40 words 30 are told apart
    own = lm_scoring.Chain(hashes[:n], np.full(n, 5), np.arange(n), np.full(n, 300), mass, 2, 12)
    a, b = hashes[3], hashes[n - 2]
    word, before = np.tile([a, b], 300), np.tile([np.uint64(11), np.uint64(22)], 300)
    skip = np.zeros(600, np.uint64)
    weights = np.zeros((1 << 12, lm_scoring.FAN), np.float32)
    for _ in range(3):
        g = np.zeros((2, *weights.shape), np.float32)
        own.gradients(weights, g, word, np.full(600, 5), before, skip)
        assert np.allclose(g[0].sum(axis=1), g[1].sum(axis=1), atol=1e-2) and np.isclose(g[0].sum(), 2 * (600 + 300))  # both words within two decisions
        weights += np.log((g[0] + 5) / (g[1] + 5)) / 2
    everything = np.append(hashes, np.arange(96, 112, dtype=np.uint64))  # and an unknown word of each group
    asked = [own.lifts(weights, everything, np.full(56, 5), np.full(56, np.uint64(h)), np.zeros(56, np.uint64)) for h in (11, 22)]
    assert asked[0][3] > asked[0][n - 2] + 0.3 and asked[1][n - 2] > asked[1][3] + 0.3
    for lift in asked:
        assert np.isclose((10.0**lift * np.append(np.full(40, 301), np.full(16, 1))).sum() / (40 * 301 + 16), 1, atol=1e-4)


def test_model_scores_by_brute_force(documents):
    """Token by token, each probability from the definition; over all words of a class, and one unknown, they sum to one."""
    m = lm_scoring
    docs = documents.limit(80)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in m.score(docs).collect()}
    model = m.fit(docs.select("doc_id", "text").where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"))
    own = model.links.value
    counts = {r["word"] % (1 << 64): (r["class"], r["c"]) for r in model.words.collect()}
    by_class = collections.defaultdict(list)
    for w, (k, c) in counts.items():
        by_class[k].append((-c, w - (1 << 64) if w >= 1 << 63 else w, w))
    ranked = {k: [w for _, _, w in sorted(v)] for k, v in by_class.items()}

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    def lifted(class_, level, before, skip):
        row = [((mix((h + k) % (1 << 64)) ^ mix(class_ * (m.LEVELS + 1) + level + 1)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - own.bits) for h, k in ((before, 1), (skip, 2))]
        return np.exp(model.inner[row[0]].astype(float) + model.inner[row[1]])

    def within(word, class_, before, skip):
        mass, p = sum(counts[w][1] + 1 for w in ranked.get(class_, [])) + (m.FAN if class_ else 1), 1.0
        if not class_:
            return (counts.get(word, (0, 0))[1] + 1) / mass
        for level in range(m.LEVELS):
            mine = ranked.get(class_, [])[level * (m.FAN - 1) : (level + 1) * (m.FAN - 1)]
            if not mine:
                break
            weight = [counts[w][1] + 1 for w in mine]
            rest, up = mass - sum(weight), lifted(class_, level, before, skip)
            e = [x * u for x, u in zip(weight, up, strict=False)] + [rest * up[-1]]
            if word in mine:
                return p * e[mine.index(word)] / sum(e)
            p, mass = p * e[-1] / sum(e), rest
        groups = np.ones(m.FAN)
        for w in ranked.get(class_, [])[m.LEVELS * (m.FAN - 1) :]:
            groups[w % m.FAN] += counts[w][1] + 1
        e, g = groups * lifted(class_, m.LEVELS, before, skip), word % m.FAN
        return p * e[g] / e.sum() * (counts.get(word, (0, 0))[1] + 1) / groups[g]

    for r in rows[:4]:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        hash_, class_, history, lengths = m.tokens(data, np.array([0, len(data)]))
        before, skip = m.contexts(hash_, lengths)
        total = 0.0
        for i in range(len(hash_)):
            b, s = history[i] // m.CLASSES, history[i] % m.CLASSES
            rows_ = [b, m._CLASS + b // m.BUCKETS, m._SKIP + s, m._PAIR + mix(int(history[i]) + 7) % m.PAIRS]
            z = np.exp(model.bias.astype(float) + model.weights[rows_].sum(axis=0))
            total += math.log10(z[class_[i]] / z.sum() * within(int(hash_[i]), int(class_[i]), int(before[i]), int(skip[i])))
        assert np.isclose(total, got[r["doc_id"]]["score"], rtol=1e-4)
    for class_ in (1, 7, 30):
        assert np.isclose(sum(within(w, class_, 12345, 678) for w in [*ranked.get(class_, []), *range(16)]), 1)


def test_scores_tell_words_of_a_class_apart(spark):
    """The pairs differ in the word that follows alone; both words end alike and so are of one class."""
    texts = ["red xsameend . blue ysameend . " * 20, "red xsameend . " * 3, "red ysameend . " * 3]
    ids = [[i for i in range(2000) if held(i, 7, 2) == h] for h in (False, True)]
    rows = [(i, texts[0]) for i in ids[0][:60]] + [(ids[1][0], texts[1]), (ids[1][1], texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (1 << 19, 0):
        got = {r["doc_id"]: r for r in lm_scoring.score(docs, frequent=frequent).collect()}
        right, wrong = got[ids[1][0]], got[ids[1][1]]
        assert abs(right["base_score"] - wrong["base_score"]) < 1e-9 and right["score"] > wrong["score"] + 1
