from collections import Counter

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """With so few labels no cutoff is certified, so the base test decides alone."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]

    def good(text):
        w = brute.words(text)
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len(w) >= 10 and 100 * len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}) <= 20 * len(w)

    rows = [r for r in rows if good(r[1])]
    gone = brute.lines_gone([r[:2] for r in rows])
    left = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]), s, len(gone[i, t])) for i, t, s in rows]
    rows = sorted((i, t, s) for i, t, s, n in left if not n or brute.words(t))
    label, _ = brute.linked([brute.shingles(t) for _, t, _ in rows], 75)
    rows = [r for k, r in enumerate(rows) if label[k] == k or not brute.words(r[1])]
    copies, _ = brute.mixed(rows)
    want = Counter({d[0]: n for d, n in copies.items() if n})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == want and all(r["text_ok"] for r in got)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
