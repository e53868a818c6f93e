from spanwork.llm.fold import fold
from spanwork.llm.leaks import Runs, leaked_documents, search

OWN = "Turn the lintel numbered 879666 around its end point, then stretch it by 4593 mm so that the wheelchair route can pass the dark room with 0.887 m to spare."
LIKE = "Turn the lintel numbered 412377 around its end point, then stretch it by 1200 mm so that the wheelchair route can pass the dark room with 0.551 m to spare."
RULE = "Lengths are in metres unless the request says otherwise, and angles run anticlockwise seen from above."
SECOND = "Count every IfcColumn that touches the refuse bay, subtract the 12 pieces below 2.586 m, and answer with the number found east of axis F/23."
NOISE = "The heating team needs the quiet room cleared before Monday. The plinth carries 883 kg, the old calculation assumed 532 kg. "

DOCUMENTS = {
    1: NOISE + OWN + " " + NOISE,
    2: NOISE + OWN.upper(),
    3: "Turn the <b>lintel</b> numbred 879666 around its end &amp; point, then lengthen it by\n  4593 mm so that, mind you, the wheelch\u200bair route can p\u0430ss the dark room with 0.887 m to sp-\nare.",
    4: NOISE + "it by 4593 mm so that the wheelchair route can pass the dark room with 0.887 m ..." + NOISE,
    5: NOISE + LIKE,
    6: NOISE + RULE,
    7: "it read 4593 mm so that the wheelchair and then nothing",
    8: NOISE,
    9: None,
    10: "",
    11: NOISE * 3000 + SECOND + NOISE * 3000,
    12: OWN.replace("4593", "4594"),
}


def frames(spark, items, documents):
    return (
        spark.createDataFrame([(*r, "s", 1) for r in items], "item_id long, text string, suite string, doc_id int"),
        spark.createDataFrame([(i, t, 1) for i, t in documents], "doc_id long, text string, item_id int"),
    )


ITEMS = [(1, f"{RULE} {OWN}"), (2, f"{SECOND} {RULE}"), (3, RULE + " Half the score goes when the wet lab keeps fewer than 21 links, when axis B/3 drifts by 4281 mm."), (4, None), (5, ""), (None, OWN)]


def test_leaks(spark):
    items, documents = frames(spark, ITEMS, [*DOCUMENTS.items(), (1, DOCUMENTS[1]), (None, OWN)])
    got = {(r.item_id, r.doc_id) for r in leaked_documents(spark, items, documents).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 11)}


def test_blocks_give_the_same(spark, monkeypatch):
    import spanwork.llm.leaks as leaks

    items = [(1, f"{RULE} {OWN}"), (2, f"{SECOND} {RULE}"), (3, f"{RULE} {LIKE}"), (4, f"{RULE} Count all doors of the lower deck.")]  # a standing instruction
    stretch = "every one of them said that the long stretch of words in two items is no leak of either"
    items += [(5, f"Say it: {stretch} of these doors."), (6, f"Write down that {stretch} of those walls.")]
    items, documents = frames(spark, items, [*DOCUMENTS.items(), (20, NOISE + stretch)])
    for block in (leaks.BLOCK, 1, 60):
        monkeypatch.setattr(leaks, "BLOCK", block)
        assert {tuple(r) for r in leaked_documents(spark, items, documents).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 11), (3, 5)}


def test_empty(spark):
    items, documents = frames(spark, [], DOCUMENTS.items())
    assert leaked_documents(spark, items, documents).count() == 0
    items, documents = frames(spark, ITEMS, [])
    assert leaked_documents(spark, items, documents).count() == 0


def test_fold():
    assert fold("PASS\u200b the b\u0435am &amp; <i>wall</i> glissÃ©") == "pass the beam &  wall  glissé"


def test_passages_without_figures():
    own = "Please move every door of the northern stair hall towards the courtyard wall so that visitors can reach the lift without crossing the loading bay"
    runs = Runs.of([(1, own + "."), (2, "Place the wall of the upper floor next to the old lift shaft and keep its height at 320 mm.")])
    assert search(runs, ["As agreed. " + own + ". Thanks."]) == [(0, 1)]
    assert search(runs, ["Note: " + " ".join(own.split()[4:20]) + " was said"]) == [(0, 1)]
    assert search(runs, ["Place the wall of the upper floor next to the old lift shaft and keep its height at 450 mm."]) == []
    shared = " ".join(own.split()[:16])
    both = Runs.of([(1, shared + " one door only."), (2, shared + " other things here, please, and nothing else of all this.")])
    assert search(both, ["He wrote: " + " ".join(shared.split()[1:15]) + " yesterday"]) == []
