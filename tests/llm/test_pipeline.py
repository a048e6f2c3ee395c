"""The pipeline against a brute-force version of each stage, on what the stage before it really left."""

import corpus_pipeline
from siteloom.llm import common, packing, quality

from .test_dedup import DATA, slow_near, slow_substring
from .test_mixing import slow_targets


def test_stages_do_what_brute_force_does(spark):
    docs = common.documents(spark, DATA)
    kinds, left = docs.schema, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), name)
        left[name] = docs.collect()
        if name != names[-1]:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in kinds]
    every = {r.doc_id: r for r in common.documents(spark, DATA).collect()}

    kept = {r.doc_id for r in quality.query(spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in left["quality_rules"]} == kept and all(r == every[r.doc_id] for r in left["quality_rules"])
    assert 0 < len(kept) < len(every)

    rows = [(r.doc_id, r.text) for r in left["quality_rules"]]
    first = {}
    for (d, _), root in zip(rows, slow_near(rows)):
        first[root] = min(d, first.get(root, d))
    assert sorted(r.doc_id for r in left["simhash_near_dedup"]) == sorted(first.values())
    assert all(r == every[r.doc_id] for r in left["simhash_near_dedup"])

    want = slow_substring([(r.doc_id, r.text) for r in left["simhash_near_dedup"]])
    got = {r.doc_id: r for r in left["substring_dedup"]}
    assert set(got) == {d for d, (n, gone, _) in want.items() if gone < n or not gone}
    import hashlib

    for d, r in got.items():
        n, gone, sha = want[d]
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == sha
        assert r.text == every[d].text if not gone else r.n_chars == len(r.text)

    size = lambda r: len((r.text or "").encode().split())
    sizes, longest = {}, {}
    for r in left["substring_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
        longest[r.source] = max(longest.get(r.source, 0), size(r))
    taken = dict.fromkeys(sizes, 0)
    for r in left["mixing"]:
        assert r == got[r.doc_id]
        taken[r.source] += size(r)
    goal = slow_targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 2 * longest[s] for s in sizes)

    rows = left["best_fit_packing"]
    encode = packing.encoding.encoder(packing.encoding.vocabulary()).encode
    assert sum(r.length for r in rows) == sum(len(encode(r.text or "")) // 4 + 1 for r in left["mixing"])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 2


def test_clean_documents_stay(spark):
    """Documents with a good label pass the quality stage but for a few."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0")
    good = common.documents(spark, d).join(labels, "doc_id").selectExpr("doc_id", "size(split(trim(text), '\\\\s+')) as n").where("n >= 50")
    kept = corpus_pipeline.STAGES[0][1](spark, common.documents(spark, d), d).select("doc_id")
    n, k = good.count(), good.join(kept, "doc_id", "left_semi").count()
    assert k >= 0.97 * n
