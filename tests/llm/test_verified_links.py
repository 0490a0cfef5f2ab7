"""The exact comparison of step 4 of the n-gram Jaccard join."""

import inspect

from obsfuse.llm import jaccard_join


def test_verified_brings_sets_together_by_group_and_links_each_component_once(spark):
    members = spark.createDataFrame([(k, [1, 2, 3, 4]) for k in (1, 2, 3)] + [(4, [7, 8, 9])], "key bigint, tokens array<bigint>")
    pairs = [(1, 2, 1, 2, 0, 0, 0), (1, 2, 1, 2, 0, 0, 0), (1, 3, 1, 3, 0, 0, 0), (2, 3, 2, 3, 0, 0, 0), (3, 4, 3, 4, 0, 0, 0)]
    near = spark.createDataFrame(pairs, "a bigint, b bigint, ra bigint, rb bigint, bucket bigint, i int, j int")
    got = jaccard_join._verified(near, members, 3, 4).collect()
    assert len(got) == 2 and {x for r in got for x in (r.a, r.b)} == {1, 2, 3}


def test_module_defines_verified_once():
    assert inspect.getsource(jaccard_join).count("def _verified(") == 1
