"""The rows of the whole pipeline against plain versions of its five stages."""

import collections
import hashlib

import numpy as np

import corpus_pipeline
from strata.llm import bpe, mixing, quality_rules
from tests.llm.test_free import brute_components
from tests.llm.test_native import WORD, brute_lines, brute_verdict, poisson_cdf


def brute_copies(rows):
    """(doc_id, text, source), each as often as its draw says: the count of k whose probability of at most k lies below it."""
    n = collections.Counter(source for _, _, source in rows)
    means = {s: len(rows) / len(n) / k for s, k in n.items()}
    cdf = {s: poisson_cdf(m, 0, int(m + 12 * m**0.5 + 30)) for s, m in means.items()}
    for i, text, source in rows:
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[: mixing.DIGITS], 16) + 0.5) / 16**mixing.DIGITS
        yield from [(i, text)] * sum(c < u for c in cdf[source])


def test_run_brute(spark, sf):
    from tokenizers import Tokenizer

    sf = sf.replace("sf0.001", "sf0.01")
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(documents, labels)
    given = {r["doc_id"]: (r["text"], r["source"]) for r in documents.select("doc_id", "text", "source").collect()}
    left = {i: x for i, (x, _) in given.items() if brute_verdict(x, rules)[-1]}
    sizes = [len(given), len(left)]
    lines = brute_lines(left.items())
    left = {i: new for i, _, new, removed in lines if not removed or WORD.search(new)}
    sizes.append(len(left))
    assert any(key[3] for key in lines)
    stay = {c for _, _, c in brute_components(left.items())}
    left = {i: x for i, x in left.items() if i in stay}
    sizes.append(len(left))
    assert sizes == sorted(set(sizes), reverse=True)  # each of these stages has something to do
    library, want = Tokenizer.from_file(bpe.vocabulary_path()), collections.Counter()
    for i, x in brute_copies([(i, x, given[i][1]) for i, x in left.items()]):
        ids = library.encode(x, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert max(want.values()) > 1
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
