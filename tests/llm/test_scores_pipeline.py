"""Learned scores by held-out accuracy; the pipeline against a brute-force version of its stages."""

import bisect
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from coopspark.llm import common, mixing, quality, queries, toxicity
from coopspark.plans.stage import written

SF = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize(("name", "label", "least", "right"), [("op3_toxicity", "toxic", 0.93, 0.95), ("op4_quality", "quality", 0.99, 0.98)])
def test_held_out(spark, name, label, least, right):
    out = queries.queries()[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) >= least
    assert (rows.predicted == rows[label]).mean() >= right


@pytest.mark.parametrize(("op", "label", "keep"), [(toxicity, "toxic", "keep_clean"), (quality, "quality", "keep_good")])
def test_scores_odd_rows(spark, op, label, keep):
    texts = [f"fine words number {i} here today" if i % 3 else f"you vile{i % 2} idiot!!! $$$ ### %%% &&& ||| {i}" for i in range(90)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (500, None), (501, ""), (3, texts[3]), (502, "long " * 60_000)]
    docs = spark.createDataFrame([(a, b, 0.5, True) for a, b in rows], "doc_id bigint, text string, score double, held_out boolean")
    bad = [(i, int((i % 3 == 0) == (label == "toxic"))) for i in range(90)]
    labels = spark.createDataFrame([*bad, (None, 1), (7, None), (9999, 1)], f"doc_id bigint, {label} int")
    model = op.fit(docs, labels)
    out = op.score_documents(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert op.score_documents(docs.limit(0), model).count() == 0
    good = {i for i in range(90) if i % 3}
    got = getattr(op, keep)(docs, model)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect() if r.doc_id is not None and r.doc_id < 90} == good
    nothing = op.fit(docs.limit(0), labels.limit(0))
    assert len(op.score_documents(docs, nothing).collect()) == len(rows)


def shape(text):
    """The quality features from their description, byte by byte and word by word."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 27
    n, blank = len(words), b" \t\n\x0b\x0c\r"
    solid = max(1, sum(b not in blank for b in raw))
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!?", b"|", b"#$%&*@^~=+", b"<>{}[]()", b"/\\_-", b"'\"`"]
    number = [sum(b in k for b in raw) for k in kinds]
    out = [math.sqrt(c / solid) for c in [*number, sum(b > 127 for b in raw)]]
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops, loud, bars, signs = number[3], number[5], number[6], number[7]
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in collections.Counter(raw).values())
    next_ = list(itertools.pairwise(words))
    out += [math.log1p(n) / 10, math.log1p(mean), math.log1p(max(sizes)) / 5, sum(x <= 3 for x in sizes) / n, len(set(words)) / n, math.log(n / len(set(words))), len(set(next_)) / max(1, n - 1), math.sqrt(sum(a == b for a, b in next_) / n)]
    out += [len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))) / 5, math.log1p(n / (1 + stops)) / 5, entropy / 8, min(1, bars / n), min(2, (loud + signs) / n), math.sqrt(sum((x - mean) ** 2 for x in sizes) / n) / 10]
    return out


def test_queries_score_every_document_from_its_weights(spark, sf_dir):
    """The registered queries against scores worked out one by one, in plain Python, from the fitted weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(docs, labels)

    def toxic(text):
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        shown = {k for k in model.weights if any(w == k[:-1] if k[-1] == "$" else w.startswith(k[:-1]) for w in words)}
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights[k] for k in shown))))

    out = queries.op3_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.score == pytest.approx(toxic(texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.5)
    ranks = quality.fit(docs, labels)

    def good(text):
        f = np.array(shape(text))
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip([*f, *(f * f)], ranks.mean, ranks.scale, strict=True)]
        strength = sum(a * b for a, b in zip(x, ranks.weights, strict=True))
        at = bisect.bisect_right(ranks.strengths, strength)
        if at in (0, len(ranks.strengths)):
            return float(ranks.scores[min(at, len(ranks.scores) - 1)])
        (s0, s1), (q0, q1) = ranks.strengths[at - 1 : at + 1], ranks.scores[at - 1 : at + 1]
        return q0 + (q1 - q0) * (strength - s0) / (s1 - s0)

    out = queries.op4_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.score == pytest.approx(good(texts[r.doc_id]), abs=1e-6)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_repeated_ids_do_not_exceed_the_sample(spark):
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(500)] + [(i, f"own {i}") for i in range(10, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(3, 1), *[(i, i % 2) for i in range(10, 40)]], "doc_id bigint, toxic int")
    sample = common.labelled_sample(docs, labels, "toxic", 10)
    assert sample.count() <= 10 and sample.count() == sample.select("doc_id").distinct().count()
    assert {r.text for r in sample.where("doc_id = 3").collect()} <= {"text 0"}


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties and extra columns go through all stages; an empty table gives an empty one."""
    texts = [f"The house number {i} stands near the old river, and many people walk there in summer." for i in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None), (70, None, "en", "s1", 0, "x"), (71, "", "en", None, 0, "x"), (72, "long words here. " * 20_000, "en", "s0", 1, "x"), rows[5], rows[5]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    labels = [(i, 1, int(i % 20 == 0)) for i in range(40)] + [(50, 0, 0), (None, 1, 1), (51, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    full, sizes = spark.createDataFrame(rows, schema), []
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, docs, str(tmp_path)))
            if name != "byte_bpe":
                assert after.columns == docs.columns
                docs = after
        assert after.count() == docs.count()
        sizes.append(after.count())
    assert sizes[0] > 0 and sizes[1] == 0


def test_features_of_few_toxic_documents_are_kept(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i)) + "klmnop"
    rows = [(True, f"crude {word(i)}" + " vile" * (i < 3)) for i in range(350)] + [(False, word(i)) for i in range(7000)]
    sample = spark.createDataFrame(rows, "positive boolean, text string")
    # 2 * 3 ln(7350 / 350) = 18.3, but 2 ln(number tried) is above 19.
    assert {"crude$", "vile$"} <= set(toxicity.choose_features(sample, 350, 7000))


def test_nnpu_prefers_the_corrected_risk():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    x = np.column_stack([truth & (rng.random(4000) < 0.8), rng.random(4000) < 0.5]).astype(np.float32)
    positive = truth & (rng.random(4000) < 0.4)
    weights, bias = toxicity.fit_nnpu(x, positive, 0.3)
    score = x @ weights + bias
    assert ((score > 0) == (x[:, 0] == 1)).all()


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 4))
    good = x[:, 0] + 0.1 * rng.standard_normal(500) > 0
    w = quality.fit_pairs(x, good)
    assert w[0] > 5 * np.abs(w[1:]).max()


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain versions on what the predecessor kept."""
    from test_minhash import brute
    from test_tokens import P, bpe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {}
    from coopspark.plans.stage import written

    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        docs = written(stage(spark, docs, sf_dir))
        if name != "byte_bpe":
            assert docs.columns == columns
    assert len(rows["quality"]) < len(rows["toxicity"]) and len(rows["near_duplicates"]) < len(rows["quality"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for before, after, operator, kept in (("toxicity", "quality", toxicity, 0), ("quality", "near_duplicates", quality, 1)):
        came = spark.createDataFrame(rows[before], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
        decided = operator.score_documents(came, operator.fit(came, labels)).where(f"predicted = {kept}").collect()
        assert sorted(r.doc_id for r in decided) == sorted(r.doc_id for r in rows[after])
    want = {d for d, n, c, k in brute([(r.doc_id, r.text) for r in rows["near_duplicates"]], 5, 80) if k}
    assert {r.doc_id for r in rows["mixing"]} == want
    copies = {r.doc_id: r.copies for r in mixing.sample(spark.createDataFrame(rows["mixing"])).collect()}
    taken = {}
    for r in rows["byte_bpe"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {d: c for d, c in copies.items() if c}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(None, P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, library.encode_ordinary(r.text))).encode()).hexdigest()) for r in rows["byte_bpe"])
    assert sorted((r.doc_id, r.ids_sha256) for r in docs.collect()) == expected
    assert corpus_pipeline.run(spark, sf_dir).count() == len(expected)
