"""A class has a row a collection in the search for centres, however many buckets it shares."""

from rowlens.llm.minhash import COLLECTIONS, PERCENT, _neighbours, _to_centres


def test_a_class_has_a_row_a_collection(spark):
    rows = [(node, node, 100, 90 + node, [7] * COLLECTIONS) for node in range(1, 9)]
    live = spark.createDataFrame(rows, "node long, component long, n long, c long, keys array<long>")
    assert _neighbours(live).count() == 8 * COLLECTIONS
    assert set(map(tuple, _to_centres(live, PERCENT).distinct().collect())) == {(8, node) for node in range(1, 8)}


def test_one_component_needs_no_centre(spark):
    rows = [(node, 1, 100, 90, [7] * COLLECTIONS) for node in range(1, 4)] + [(9, 9, 100, 90, list(range(COLLECTIONS)))]
    live = spark.createDataFrame(rows, "node long, component long, n long, c long, keys array<long>")
    assert _to_centres(live, PERCENT).count() == 0
