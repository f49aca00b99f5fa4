"""Profiles of documents and items with links, over rows of pages, lines and links."""

from plenum.operators.layouts import linked_items, profiles

PAGES, LINKS, OUTLINE = "doc_id int, page int, text string", "doc_id int, page int, kind string", "doc_id int, level int, page int"


def test_profiles(spark):
    pages = [(1, p, f" {p}. Item\nplain\n\u200bIV. Roman\n" + "x" * 20) for p in range(1, 18)] + [(2, 1, None)]
    links = [(1, 2, "uri"), (1, 2, "internal"), (1, 9, "uri"), (1, 16, "uri"), (1, 3, "named"), (3, 1, "uri")]
    outline = [(1, 1, 1), (1, 2, 1), (1, 2, -1), (1, 3, 16)]
    got = {r["doc_id"]: r for r in profiles(spark.createDataFrame(pages, PAGES), spark.createDataFrame(links, LINKS), spark.createDataFrame(outline, OUTLINE)).collect()}
    one, two = got[1], got[2]
    assert set(got) == {1, 2}
    assert (one["page_count"], one["scanned_pages"], one["item_number_lines"], one["has_text_layer"]) == (17, 15, 30, True)
    assert one["text_chars"] == sum(len(t.strip()) for _, p, t in pages[:5])
    assert (one["external_links"], one["internal_links"], one["link_pages"]) == (2, 1, [2, 9])
    assert (one["toc_entries"], one["toc_real_entries"], one["toc_distinct_pages"], one["toc_max_depth"], one["toc_depth_counts"]) == (4, 3, 2, 3, {"1": 1, "2": 2, "3": 1})
    assert (two["page_count"], two["text_chars"], two["has_text_layer"], two["external_links"], two["link_pages"], two["toc_entries"], two["toc_depth_counts"]) == (1, 0, False, 0, [], 0, None)


def test_linked_items(spark):
    lines = [(1, 1, 10.0, "AGENDA"), (1, 1, 50.0, "1. Trees on Main"), (1, 1, 60.0, "more on it"), (1, 2, 5.0, "\ufeff2.a Pool hours"), (1, 25, 5.0, "7. Exhibit"), (2, 1, 1.0, None)]
    links = [(1, 1, 20.0, "top"), (1, 1, 50.0, "beside"), (1, 2, 1.0, "carried"), (1, 2, 9.0, "b"), (1, 2, 9.0, "a"), (1, 30, 1.0, "late"), (1, 1, 1.0, None)]
    got = linked_items(spark.createDataFrame(lines, "doc_id int, page int, y double, text string"), spark.createDataFrame(links, "doc_id int, page int, y double, url string"))
    assert sorted((r["doc_id"], r["place"], r["number"], r["title"], r["urls"]) for r in got.collect()) == [
        (1, 0, None, None, ["top"]), (1, 1, "1.", "Trees on Main", ["beside", "carried"]), (1, 2, "2.a", "Pool hours", ["a", "b", "late"]),
    ]
