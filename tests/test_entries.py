import pytest

from lexmill.operators.entries import EntryFilter, entry_page

ENTRY = "id long, headword string, volume_id int, page_number int, created_at int, needs_review boolean, match string, lemma boolean"
ROWS = [
    (1, "Abbey", 1, 3, 9, True, "accepted", True), (2, "abbot", 1, 4, 8, False, None, True), (3, "Babble", 2, 1, 7, None, None, False), (4, "b_ll", 2, 2, 6, True, "unique", True), (5, "bell", 2, None, 5, False, None, True), (6, "abate", 1, 1, 4, False, "pruned", True),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, ENTRY), spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (4, 1, "b"), (4, 1, "a"), (9, 1, "lost")], "entry_id long, nth int, text string")


@pytest.mark.parametrize("only, want", [
    (EntryFilter(), [6, 1, 2, 4, 3, 5]), (EntryFilter(contains="AB"), [6, 1, 2, 3]), (EntryFilter(contains="b_l"), [4, 3, 5]), (EntryFilter(volume=2), [4, 3, 5]), (EntryFilter(letter="A"), [6, 1, 2]),
    (EntryFilter(needs_review=True), [1, 4]), (EntryFilter(needs_review=False), [6, 2, 5]), (EntryFilter(match="unique"), [4]), (EntryFilter(match="unchecked"), [2, 5]), (EntryFilter(volume=7), []),
    (EntryFilter(letter="b", match="unchecked"), [5]),
])
def test_filters(tables, only, want):
    rows = entry_page(*tables, only).collect()
    by = {r.id: r for r in rows}
    assert sorted(by) == sorted(want) and all(r.total == len(want) for r in rows)
    assert all(r.first_definition == {1: "first", 4: "a"}.get(r.id) for r in rows)


def test_pages_and_orders(tables):
    ids = lambda **k: {r.id for r in entry_page(*tables, size=2, **k).collect()}
    assert ids() == {6, 1} and ids(number=2) == {2, 4} and ids(number=3) == {3, 5} and ids(number=4) == set()
    assert ids(sort="created_at") == {6, 5} and ids(sort="created_at", descending=True) == {1, 2} and ids(sort="page_number", number=3) == {2, 5}
    with pytest.raises(ValueError):
        entry_page(*tables, sort="text")
