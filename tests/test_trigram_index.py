"""The trigram index has the address ids of each key, copies kept, as those of phrases and skip pairs have."""

from collections import defaultdict

from waymark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_trigram_posting_lists(spark):
    want = defaultdict(list)
    for r in registry.QUERIES["trigram_phrases"](spark, FOLDER).collect():
        want[r.trigramphrase].append(r.addr_id)
    got = registry.QUERIES["trigram_inverted_index"](spark, FOLDER).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.addr_ids, r.frequency) == (",".join(map(str, sorted(want[r.trigramphrase]))), len(want[r.trigramphrase]))
