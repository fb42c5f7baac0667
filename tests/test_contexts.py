"""Places and surroundings of numbers, against a plain search."""

import re

from quire.functions import text as t


def test_places_and_contexts(spark):
    texts = ["", None, "7", "no number here", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25",
             "x" * 500 + " 12 " + "y" * 500 + " 13", "\n 4 \n", "grö\u00dfe 12 \U0001f600 5 \u00e9 xiv end", "a1 1a 3.5 2024-11-30 IV,ii;vi",
             " ".join(f"{n} word" for n in range(300))]
    pages = spark.createDataFrame([("b", k, x) for k, x in enumerate(texts)], "book_id string, scan_index int, full_text string")
    for reach in (3, 20):
        found = sorted(tuple(r) for r in t.located_numbers(pages, reach=reach).where("number_type = 'arabic'")
                       .drop("number_type", "book_id").collect())
        expected = []
        for k, text in enumerate(texts):
            for n, m in enumerate(re.finditer(r"(?<!\w)[0-9]+(?!\w)", text or "")):
                around = text[max(0, m.start() - reach):m.end() + reach].strip()
                expected.append((k, n, m.group(), m.start() + 1, len(m.group()), around))
        assert found == sorted(expected)
    roman = [(r.text, r.start) for r in t.located_numbers(pages).where("number_type = 'roman'").orderBy("scan_index", "ord").collect()]
    assert roman == [("xiv", texts[7].index("xiv") + 1), *[(x, texts[8].index(x) + 1) for x in ("IV", "ii", "vi")]]
