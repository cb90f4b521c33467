"""Hand-made pages for lines, blocks and reading order."""

from foliospark.operators import layout
from foliospark.operators.layout import Run


def run(name, x0, y0, text="word", size=10.0, x1=None, font="Times"):
    return Run(name, text, font, size, float(x0), float(y0), float(x0 + 5 * len(text) if x1 is None else x1), float(y0 + size))


def texts(blocks):
    return [[line.text for line in b.lines] for b in blocks]


def test_wrapped_lines_are_one_block_and_a_heading_is_its_own():
    runs = [run("a", 50, 100, "IV. Results"), run("b", 50, 116, "first line of a para", x1=250), run("c", 50, 128, "second line of it ok", x1=250), run("d", 50, 140, "end.")]
    assert texts(layout.blocks_of(runs, 1, 600)) == [["IV. Results"], ["first line of a para", "second line of it ok", "end."]]


def test_columns_do_not_share_lines_and_a_wide_line_separates():
    runs = [run("l1", 50, 100, "left one"), run("r1", 350, 100, "right one"), run("l2", 50, 112, "left two"), run("w", 50, 200, "x" * 100, x1=550), run("l3", 50, 300, "below left"), run("r3", 350, 250, "below right")]
    blocks = layout.in_bands(layout.blocks_of(runs, 2, 600), lambda g: g.y0, layout.band_order)
    assert [b.lines[0].text[:8] for b in blocks] == ["left one", "right on", "xxxxxxxx", "below le", "below ri"]


def test_rows_are_anchored_not_chained():
    groups = [layout.Group(0, [run(n, x, y)]) for n, x, y in (("a", 0, 0), ("b", 100, 1.5), ("c", 200, 3.0))]
    assert [[g.runs[0].obj_id for g in row] for row in layout.visual_rows(groups)] == [["a", "b"], ["c"]]


def test_aligned_grid_reads_by_rows():
    groups = [layout.Group(lane, [run(f"{r}{lane}", 50 + 300 * lane, 100 + 30 * r)]) for lane in (0, 1) for r in range(3)]
    assert [g.runs[0].obj_id for g in layout.band_order(groups)] == ["00", "01", "10", "11", "20", "21"]
    assert [g.runs[0].obj_id for g in layout.band_order(groups[:5])] == ["00", "10", "20", "01", "11"]


def test_spaces_hyphens_and_cjk():
    assert layout.line_text([run("a", 0, 0, "two"), run("b", 20, 0, "words")]) == "two words"
    assert layout.line_text([run("a", 0, 0, "one"), run("b", 15.5, 0, "word")]) == "oneword"
    assert layout.line_text([run("a", 0, 0, "中文"), run("b", 20, 0, "字")]) == "中文字"
    assert layout.line_text([run("a", 0, 0, "中 文")]) == "中文"
    assert [layout.joined(a, b) for a, b in (("exam-", "ple"), ("中", "文"), ("end", ", so"), ("a", "b"), ("(", "x"), ("5-", "3"))] == ["example", "中文", "end, so", "a b", "(x", "5- 3"]


def test_marker_is_cut_from_its_line_and_stands_alone():
    blocks = layout.blocks_of([run("m", 50, 100, "•"), run("t", 65, 100, "item text"), run("n", 65, 112, "goes on")], 1, 600)
    assert texts(blocks) == [["•"], ["item text", "goes on"]]


def test_pages_of_a_table_and_every_run_is_kept(spark):
    from foliospark.operators import probes
    from foliospark.sources import typeset

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30")
    objects, pages = typeset.objects(docs), typeset.pages(docs)
    found = layout.text_blocks(objects, probes.columns(objects, pages).join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]))
    assert found.where("engine = 'fallback'").count() == 0
    ids = found.selectExpr("doc_id", "explode(obj_ids) AS obj_id")
    runs = objects.where("kind = 'text' AND text != ''").select("doc_id", "obj_id")
    assert ids.exceptAll(runs).isEmpty() and runs.exceptAll(ids).isEmpty()
