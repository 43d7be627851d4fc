"""The pipeline's stages against brute-force versions, each on its own input."""

from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_substring_dedup import brute_passages  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.written(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "suffix_array_dedup", "packing"]


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert np.mean([i in kept for i, t in labels.items() if t == 0]) > 0.99
    assert np.mean([i in kept for i, t in labels.items() if t == 1]) < 0.6  # of ten such labels at this size
    model = pipeline.toxic.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in pipeline.toxic.score(stages[0], model).collect() if r.score < 0.5}


def test_lines(stages):
    rows, after = stages[1].collect(), {r.doc_id: r for r in stages[2].collect()}
    total = Counter(r.source for r in rows)
    count = Counter((r.source, x) for r in rows if r.text is not None for x in set(r.text.split("\n")))
    for r in rows:
        keep = [x for x in r.text.split("\n") if not x.strip(" ") or not (count[r.source, x] > 0.1 * total[r.source] and count[r.source, x] >= 5)]
        assert after[r.doc_id].text == "\n".join(keep) and after[r.doc_id].n_chars == len("\n".join(keep))
    assert len(after) == len(rows)


def test_near_copies(stages):
    sets = {r.doc_id: shingled(r.text) for r in stages[2].collect()}
    ids, label = sorted(sets), {i: i for i in sets}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert {r.doc_id for r in stages[3].collect()} == {i for i in ids if label[i] == i}


def test_repeats(stages):
    rows, after = stages[3].collect(), {r.doc_id: r.text for r in stages[4].collect()}
    for r, (kept, _, _) in zip(rows, brute_passages([r.text for r in rows], 200, 50), strict=True):
        assert after[r.doc_id] == kept.decode("utf-8", "ignore")


def test_short_passages_go_and_clean_documents_stay(spark, documents):
    r = np.random.default_rng(5)
    vocabulary = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(3000)]
    text = lambda n: list(r.choice(vocabulary, n))
    passages = {n: " ".join(text(n)) for n in range(51, 61)}
    rows, planted = [], {}
    for n, p in passages.items():
        for _ in range(3):
            i = len(rows)
            rows.append((i, f"{' '.join(text(80))} | {p} | {' '.join(text(90))}"))
            planted[i] = p
    clean = {len(rows) + k: " ".join(text(200)) for k in range(40)}
    # 30 words that two clean documents share are no passage
    first, second, *_ = clean
    clean[second] += " | " + " ".join(clean[first].split()[50:80])
    docs = documents([*rows, *clean.items()])
    got = {x.doc_id: x.text for x in pipeline.repeats(spark, docs, SF).collect()}
    assert all(p not in got[i] and got[i] == rows[i][1].replace(f" | {p} | ", "") for i, p in planted.items())
    assert all(got[i] == t for i, t in clean.items())


def test_windows(stages):
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in stages[4].collect()}
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 4096 and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_odd_rows(spark, stages):
    odd = [(None, "x y", "en", None, 3), (None, None, None, None, None), (5, "same words are here now ok", "en", "s", 1), (5, "same words are here now ok", "en", "s", 1)]
    docs = spark.createDataFrame(odd, stages[0].schema).withColumnRenamed("lang", "score")
    for _, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) == [(0, ""), (0, "x y"), (5, "same words are here now ok")]
    # an id on two texts that aren't alike names two documents; null ids give way to ids, and texts without words stay
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(7, near), (7, "another text of six words here"), (None, near + " x"), (9, near + " y"), (None, None), (None, " "), (None, None)]
    kept = pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [rows[0], rows[1], *rows[4:]])
    long = [(1, "x" * 300_000), (2, "word " * 100_000), (3, "a line\n" * 20_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in long], stages[0].schema)
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3}
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, stages[0].limit(0), SF).count() == 0
