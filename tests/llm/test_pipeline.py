"""The pipeline's stages on the smallest tables, each against its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from matchloom.llm import mixing
from matchloom.llm.common import table
from matchloom.session import materialize
from tests.llm.test_llm_operators import SF, brute_targets, check_packing, words
from tests.llm.test_near_copies import shingles, similarity


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), "stage"))
    raw, clean, exact, near, mixed, packed = seen
    assert all(d.columns == columns for d in (clean, exact, near, mixed))
    assert 0.7 * raw.count() < clean.count() <= raw.count()
    bare = Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in clean.collect())
    assert Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in exact.collect()) == Counter(set(bare))
    sets = {r["doc_id"]: shingles(r["text"]) for r in exact.collect()}
    kept = {r["doc_id"] for r in near.collect()}
    assert len(kept) == near.count() and kept <= set(sets)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j != i)
        best = max((similarity(s, sets[j]) for j in shared), default=0)
        assert i in kept or best >= 0.74  # the similarity is estimated to about 0.02
        assert i not in kept or all(j not in kept or similarity(s, sets[j]) < 0.86 for j in shared)
    sizes, longest, taken = Counter(), Counter(), Counter()
    for r in near.collect():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    target = brute_targets(sizes, mixing.WEIGHTS)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    assert check_packing(mixed, packed.collect(), pipeline.public_tokenizers.path("word_bpe_49k.json")) > 0.95
