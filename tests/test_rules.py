"""Small rules on hand-written rows."""

from pyspark.sql import functions as F

from quire.functions import numerals, text as t
from quire.operators import content, dataset, scans
from quire.sources import files, sinks, tokens


def test_roman_values(spark):
    words = {"vi": 6, "xiv": 14, "iiii": 4, "vx": 5, "mix": 1009, "abc": None, "": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", numerals.roman_value(F.col("w"))).collect()} == words
    assert [numerals.written_roman(n) for n in (4, 9, 14, 40, 49)] == ["iv", "ix", "xiv", "xl", "xlix"]


def test_numbers_of_a_text(spark):
    pages = spark.createDataFrame([("b", 0, "Page vi, see 12. île 5é iiii x")], "book_id string, scan_index int, full_text string")
    got = [(r.text, r.number_type, r.numeric_value) for r in t.text_numbers(pages).orderBy("ord").collect()]
    assert got == [("12", "arabic", 12), ("vi", "roman", 6), ("x", "roman", 10)]


def test_heading_rules(spark):
    text = "Chapter 3\n  IV. Rules here\nNotes:\nPLAIN TITLE\nordinary line, with comma"
    pages = spark.createDataFrame([("b", 0, text)], "book_id string, scan_index int, full_text string")
    got = {(r.line_no, r.rule): (r.heading_type, r.heading_number) for r in t.headings(pages).collect()}
    assert got[(0, "pattern")] == ("chapter", 3)
    assert got[(1, "pattern")] == ("roman_section", 4)
    assert got[(2, "structure")][0] == "section_header"
    assert {(3, "pattern"), (3, "structure")} <= set(got)
    assert not any(line == 4 for line, _ in got)


def test_blank_modes(spark):
    flags = [True, True, False, True, False, True]
    df = spark.createDataFrame([("g", i, f) for i, f in enumerate(flags)] + [("all", i, True) for i in range(3)],
                               "book_id string, scan_index int, is_blank boolean")
    expected = {"none": [], "start": [0, 1], "end": [5], "start_end": [0, 1, 5], "middle": [3], "all": [0, 1, 3, 5]}
    for mode, pages in expected.items():
        for wide in (False, True):
            rows = scans.blank_removal(df, mode, wide).where("removed").collect()
            assert sorted(r.scan_index for r in rows if r.book_id == "g") == pages
            assert len([r for r in rows if r.book_id == "all"]) == (0 if mode in ("none", "middle") else 3)


def test_crop_golden(spark):
    df = spark.createDataFrame([("b", "p", 2480, 3508, 1200, 1600, 0.0, 0.0)],
                               "book_id string, page_name string, page_width int, page_height int, crop_width int, crop_height int, border_share double, edge_content double")
    row = scans.crop_validation(df).first()
    assert (round(row.crop_ratio, 4), row.confidence, row.needs_review, row.is_valid) == (0.2207, 70.0, True, True)


def test_label_classes(spark):
    df = spark.createDataFrame([(1, "73"), (2, "A-45"), (3, "xiv"), (4, "blank"), (5, "a b")], "sample_id int, label string")
    got = {}
    for r in dataset.label_tokens(df).orderBy("sample_id", "char_no").collect():
        got.setdefault(r.sample_id, []).append(r.char_class)
    assert got == {1: ["digit_7", "digit_3"], 2: ["letter_a", "separator_dash", "digit_4", "digit_5"],
                   3: ["letter_x", "letter_i", "letter_v"], 4: ["blank"], 5: ["letter_a", "letter_b"]}


def test_context_and_shorten(spark):
    df = spark.createDataFrame([("0123456789" * 12,)], "x string")
    row = df.select(t.context_window(F.col("x"), F.lit(31), F.lit(2)), F.length(sinks.shorten(F.col("x")))).first()
    assert row[0] == ("0123456789" * 12)[10:52] and row[1] == 103


def test_number_box_default(spark):
    blocks = spark.createDataFrame([("b", 0, 0, "x 12 y", 5, 6, 7, 8)], "book_id string, scan_index int, block_index int, text string, left int, top int, width int, height int")
    numbers = spark.createDataFrame([("b", 0, "12"), ("b", 0, "99")], "book_id string, scan_index int, text string")
    got = {r.text: tuple(r.position) for r in tokens.number_boxes(numbers, blocks).collect()}
    assert got == {"12": (5, 6, 7, 8), "99": (0, 0, 50, 20)}


def pages_of(spark, texts):
    return spark.createDataFrame([("b", i, x) for i, x in enumerate(texts)], "book_id string, scan_index int, full_text string")


def brute_continuity(texts, words):
    best = {}
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            k = min(5, len(a["last"]), len(words[j]["first"]))
            hits = sum(a["last"][-(p + 1)] == words[j]["first"][p] for p in range(k))
            if k and 2 * hits > k and (i not in best or 0.4 + 0.6 * hits / k > best[i][1] + 1e-9):
                best[i] = (j, 0.4 + 0.6 * hits / k)
    return best


def test_continuity_equals_all_pairs(spark, tiny_chunks):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    pages = pages_of(spark, texts)
    words = {r.scan_index: {"first": r.first_words, "last": r.last_words} for r in t.boundary_words(pages).collect()}
    expected = brute_continuity(texts, [words[i] for i in range(len(texts))])
    for wide in (False, True):
        got = {r.page_a: (r.page_b, r.confidence) for r in content.text_continuity(pages, wide).collect()}
        assert set(got) == set(expected)
        assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) < 1e-9 for i in expected)


def test_similarity_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.sample([f"w{n}" for n in range(14)], rng.randint(1, 9))) for _ in range(40)]
    texts += texts[:3]
    sets = [set(x.split()) for x in texts]
    first = {i: min(j for j in range(len(sets)) if sets[j] == s) for i, s in enumerate(sets)}
    expected = {(first[i], i): 1.0 for i in first if first[i] != i}
    for i in set(first.values()):
        for j in set(first.values()):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if i < j and share >= 0.3:
                expected[(i, j)] = share
    got = {(r.page_a, r.page_b): r.similarity for r in content.content_similarity(pages_of(spark, texts)).collect()}
    assert set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in expected)


def test_files_and_outputs(spark, tmp_path):
    for name in ("Page_002.jpg", "Page_010.jpg", "scan.docx"):
        folder = tmp_path / "lib" / "9780000000017"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    found = files.scan_collection(spark, str(tmp_path / "lib"), recursive=True)
    rows = files.natural_order(found, False).orderBy("scan_index").collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["Page_002.jpg", "Page_010.jpg"]
    assert {r.book_id for r in rows} == {"9780000000017"}
    lines = spark.createDataFrame([("b", "one"), ("c", "two")], "book_id string, line string")
    done = sinks.write_outputs({"summary": (lines, "text"), "bad": (lines, "no_such_format")}, str(tmp_path / "out"))
    assert done["summary"] is None and "no_such_format" in done["bad"]
    assert spark.read.text(str(tmp_path / "out" / "summary")).count() == 2


def test_gaps_of_any_width_are_exact(spark):
    from quire.operators import numbering as n

    rows = [("b", i, 0, "", "arabic", v, 80.0) for i, v in enumerate([1, 2, 4, 12000])]
    from quire.schemas import DETECTED_NUMBERS
    detected = spark.createDataFrame(rows, DETECTED_NUMBERS)
    profile = n.sequence_profile(detected).first()
    assert profile["gap_count"] == profile["missing_count"] == 11996
    found = sorted(tuple(r)[2:] for r in n.missing_numbers(detected).collect())
    assert found == [(3, 3, 1), (5, 11999, 11995)]


def test_long_numbers_are_numbers(spark):
    from quire.operators import ordering as o

    texts = ["9780632046584", "9" * 25, "99999"]
    pages = spark.createDataFrame([("b", i + 10, f"p{i}", x) for i, x in enumerate(texts)],
                                  "book_id string, scan_index int, original_name string, full_text string")
    found = t.text_numbers(pages)
    assert [r.numeric_value for r in found.orderBy("scan_index").collect()] == [9780632046584, 10**18, 99999]
    rules = {r.rule for r in o.decide(o.page_numbers(pages, found)).collect()}
    assert rules == {"unrealistic"}
