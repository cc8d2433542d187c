"""Page counts and learned confusions."""

from graphweave.llm import ocr


def _chunk(*lines):
    prose = ["the field team collects the samples of", "the lower basin before the morning and", "the crew of the night shift writes the", "short note about the pressure of pipes"]
    return "\n".join([*prose, *lines])


def test_page_counts(spark):
    rows = [("f", "f1", _chunk("9")), ("f", "f2", _chunk("1998")), ("g", "g1", _chunk("7")), ("g", "g2", _chunk("8")), ("h", "h1", _chunk("40")), ("i", "i1", _chunk("40"))]
    chunks = spark.createDataFrame([(*r, None, 1) for r in rows], "file_hash string, chunk_id string, text string, heading_hierarchy array<string>, page_count int")
    counts = [("f", 3, 1), ("f", 30, 2), ("g", 1, 1), ("h", 0, 1), ("i", 3, 1), ("i", None, 2)]
    metadata = spark.createDataFrame(counts, "file_hash string, page_count int, ingested_at int")
    found = {r.chunk_id for r in ocr.noise(chunks, metadata).where("noise = 'pageno'").collect()}
    # above the current count, and nothing else is; g's count is refuted, h and i have none
    assert found == {"f1", "g1", "g2", "h1", "i1"}
    assert "1998" in {r.chunk_id: r.text for r in ocr.repaired(chunks, metadata).collect()}["f2"]
    assert ocr.noise(chunks, metadata.limit(0)).where("noise = 'pageno'").count() == 6 == ocr.noise(chunks).where("noise = 'pageno'").count()


def test_confusions_are_learned(spark):
    words = "basin valve kettle pressure sample station pipeline harbour filter sensor tunnel gateway".split()
    rare = [(w.replace("e", "z", 1), 1) for w in words if "e" in w] + [("basim", 1), ("valves", 1)]
    rare, known = spark.createDataFrame(rare, "word string, own long"), spark.createDataFrame([(w, 100) for w in words], "word string, total long")
    found = {(r.wrong, r.right): r.change for r in ocr.confusions(rare, known).collect()}
    assert found[("z", "e")] == ord("e") ** 5 - ord("z") ** 5 and ("m", "n") not in found
    assert set(found) == {("z", "e"), *ocr.CONFUSIONS}
    assert {(r.wrong, r.right) for r in ocr.confusions(rare.limit(0), known).collect()} == set(ocr.CONFUSIONS)
