"""Boxes may come without regions; a text is then read once, however many regions hold its box."""

from quire.operators import candidates as cand


def _boxes(spark):
    texts = ["page 3", " 12 ", "a 7 x", "xii", "x i", "ii iii", "vi 6", "1234", "", None, "of 9", "iix", "999"]
    rows = [("b", k, k % 3, text, 90.0, left, top, 60, 40, 2480, 3508)
            for k, text in enumerate(texts) for left, top in ((8, 20), (1210, 3440), (2400, 1730), (700, 900))]
    return spark.createDataFrame(rows, "book_id string, scan_index int, block_index int, text string, conf double, left int, top int,"
                                       "width int, height int, page_width int, page_height int")


def test_same_candidates_without_regions(spark):
    blocks = _boxes(spark)
    placed = cand.region_assign(blocks)
    for score in (cand.candidates, cand.score_arabic, cand.score_roman):
        late, early = score(blocks), score(placed)
        columns = sorted(late.columns)
        assert columns == sorted(early.columns)
        rows = [sorted(map(str, frame.select(*columns).collect())) for frame in (late, early)]
        assert rows[0] == rows[1] and rows[0]
