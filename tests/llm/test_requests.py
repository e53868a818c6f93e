import datetime as dt
import itertools
import random

import pytest

from spanwork.llm import wordings
from spanwork.llm.near_edits import BKTree, near_edit_groups, search
from spanwork.llm.overlap import cross_split_overlap
from spanwork.llm.requests import Words, canonical, distance, figures, fingerprints_of, prefixes_of, same_edit, segments, shingles, similarity
from spanwork.llm.wordings import Wordings, decide, differences

T = "rec_id long, split string, input_ifc string, prompt string, instruction string, loaded_at timestamp, canonical string, hi int"
DAY = dt.datetime(2025, 1, 1)
REMARKS = ["Cheers for sorting this.", "Lovely weather on site today.", "Ping me once it is done.", "The budget is tight this quarter.", "Sent from the tram."]
VERBS, NAMES, SIDES = ["Demolish", "Knock down", "Scrap"], ["titled", "labelled"], ["north", "south", "east", "west"]
CONDITIONS = ["Leave the skirting untouched.", "Mind the cable tray.", ""]


def request(rng, element, side, condition):
    """One wording of one edit: none of these words stands in the library."""
    text = f"{rng.choice(VERBS)} the {element[0]} {rng.choice(NAMES)} '{element[1]}' that lies {element[2]} m to the {side} of the boiler room on 'Deck {element[3]}'."
    parts = [text] + ([condition] if condition else [])
    rng.shuffle(parts)
    for r in rng.sample(REMARKS, rng.choice([0, 0, 1, 1, 2])):
        parts.insert(rng.randint(0, len(parts)), r)
    out = " ".join(parts)
    return out.upper() if rng.random() < 0.1 else out


def planted(n=150, seed=1):
    """Rows, and the edit each record asks for."""
    rng, rows, edit = random.Random(seed), [], {}
    for k in range(n):
        model = f"x/M{k // 3}/arch.ifc"
        element = (rng.choice(["wall", "door", "slab"]), f"Panel {rng.randint(10, 99)}:{rng.randint(10**7, 10**8)}", round(rng.uniform(1, 9), 3), rng.randint(1, 12))
        side, other = rng.sample(SIDES, 2)
        condition = rng.choice(CONDITIONS)
        for j in range(4):
            decoy = j == 3
            rec_id = len(rows)
            rows.append((rec_id, ["train", "validation", "train", "train"][j], model, request(rng, element, other if decoy else side, condition), None, DAY, "x", 1))
            edit[rec_id] = (k, decoy)
    return rows, edit


def table(spark, rows):
    return spark.createDataFrame([(*r, DAY, "clash", 1) if len(r) == 5 else r for r in rows], T)


def test_segments_and_numbers():
    assert segments("0.5 m, 50cm, 500 MM, 1,5 metres and (2.50, 3)") == [("#5000", "#5000", "#5000", "#15000", "and", "2.5", "3")]
    assert segments("Note: put 'A 21:90' up! On sheet B-12\n") == [("note",), ("put", "a", "21", "90", "up"), ("on", "sheet", "b-12")]
    assert segments("") == [] and figures(segments("on B-12: 3, 0kg9aBcDeFgHiJkLmNoP_$ 2")) == "0kg9abcdefghijklmnop_$ 2 3"


def test_slips_are_put_right_by_frequency_only():
    words = Words({"storey": 5000, "window": 4000, "stroey": 7, "hall": 300, "wall": 7000, "hale": 60}, 15)
    assert words.right("stroey") == "storey" and words.right("widnow") == "window"
    assert words.right("hall") == "hall" and words.right("hale") == "hale"  # established, however near
    assert words.slip("widnow", "window") and not words.slip("hall", "wall") and not words.slip("12", "13")
    assert distance("storey", "stroey", 2) == 1 and distance("abc", "xyz", 2) == 3


def test_wordings_come_from_pairs():
    a, b = segments("Hi all. Scrap the old door 5 to the left of 7. Keep the lock."), segments("Demolish the old door 5 to the left of 7. Keep the lock. See you soon")
    alone, swapped = differences(a, b)
    assert sorted(alone) == [("hi", "all"), ("see", "you", "soon")] and swapped == [(("demolish",), ("scrap",))]
    w = decide({("hi", "all"): 9, ("keep", "the", "lock"): 1}, {(("demolish",), ("scrap",)): 8, (("left",), ("right",)): 90, (("directly",), ("right",)): 9}, {("keep", "the", "lock"): 40, ("left",): 50, ("right",): 60, ("directly",): 5}, {("keep", "the", "lock"): 40})
    assert canonical(a, w) == canonical(segments("keep the lock. demolish the old door 5 to the left of 7"), w)
    assert canonical(segments("left of it"), w) != canonical(segments("right of it"), w)
    assert ("keep", "the", "lock") in w.asking and wordings.Wordings().rewrites == {}


def test_same_edit():
    words = Words(dict.fromkeys("left right wall raise keep lock the".split(), 900), 15)
    same = lambda a, b: same_edit(a, b, words, Wordings(asking=frozenset({("keep", "the", "lock")})))
    assert same("raise wall left 5", "raise wlal left 5")
    assert not same("raise wall left 5", "raise wall right 5") and not same("raise wall left 5", "raise wall left 6")
    assert same("raise wall left 5", "raise wall left 5 ; see you soon") and not same("keep the lock ; raise wall left 5", "raise wall left 5")
    assert not same("raise wall left 5 ; to the cellar", "raise wall left 5 ; to the attic")


def test_overlap_of_unseen_wordings(spark):
    rows, edit = planted()
    extra = [(9000, "train", None, rows[1][3], None), (9001, None, rows[1][2], rows[1][3], None), (9002, "train", rows[1][2], None, None), (9003, "train", rows[1][2], "", "")]
    extra += [(None, "train", rows[1][2], rows[1][3], None), (9004, "train", rows[1][2].upper().replace("/", "\\"), None, rows[1][3])]
    extra += [(9005, "train", "x/M0/arch.ifc", rows[1][3], None, DAY, "x", 1), (9005, "train", "y/Q/arch.ifc", rows[1][3], None, DAY + dt.timedelta(1), "x", 1)]  # delivered again
    extra += [(9006, "train", rows[1][2], rows[1][3] + "".join(f" {a}{b}{c}" for a, b, c in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)), None)]
    got = cross_split_overlap(spark, table(spark, rows + extra))
    found = {(r.eval_rec_id, r.train_rec_id) for r in got.pairs().collect()}
    edit[9004] = edit[1]
    split = {r[0]: r[1] for r in rows} | {9004: "train"}
    want = {(a, b) for a, b in itertools.permutations(edit, 2) if split[a] != "train" and split[b] == "train" and edit[a] == edit[b]}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.98 * len(found)
    assert (1, 9004) in found and not {b for _, b in found} & {9000, 9001, 9002, 9003, 9005, 9006}


def test_near_edits_of_unseen_wordings(spark):
    rows, edit = planted(seed=2)
    got = near_edit_groups(spark, table(spark, rows))
    found = {(r.rec_id_a, r.rec_id_b) for r in got.pairs().collect()}
    split = {r[0]: r[1] for r in rows}
    want = {(a, b) for a, b in itertools.combinations(edit, 2) if split[a] == split[b] and edit[a] == edit[b]}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.98 * len(found)


def test_one_remark_that_nothing_was_learned_of(spark):
    base = "Move the wall numbered 90112233 by 4.5 m towards the north on its own storey 'Level 3' and keep the sill of the window beside it."
    texts = [base, base + " Greetings from the crane.", base.replace("4.5 m", "450 cm"), base.replace("north", "south"), base.replace("90112233", "90112234")]
    rows = [(i, "train" if i else "test", "a/M1/x.ifc", t, None) for i, t in enumerate(texts)]
    assert {r.train_rec_id for r in cross_split_overlap(spark, table(spark, rows)).pairs().collect()} == {1, 2}
    rows = [(i, "train", "a/M1/x.ifc", t, None) for i, t in enumerate(texts)]
    got = near_edit_groups(spark, table(spark, rows))
    assert {(r.rec_id_a, r.rec_id_b) for r in got.pairs().collect()} == {(0, 1), (0, 2), (1, 2)} and got.links.count() == 1


def test_empty_tables(spark):
    empty = table(spark, [])
    assert cross_split_overlap(spark, empty).pairs().count() == 0
    assert near_edit_groups(spark, empty).pairs().count() == 0


def test_pairs_of_a_large_group_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr("spanwork.llm.near_edits.SIDE", 7)
    rows = [(i, "train", "a/M1/x.ifc", "Remove the beam numbered 12345678 from 'Level 2'.", None) for i in range(30)]
    found = [(r.rec_id_a, r.rec_id_b) for r in near_edit_groups(spark, table(spark, rows)).pairs().collect()]
    assert sorted(found) == list(itertools.combinations(range(30), 2))


def test_bk_tree_equals_brute_force():
    rng = random.Random(3)
    keys = [rng.getrandbits(16) for _ in range(400)]
    tree = BKTree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    for q in keys[:50]:
        for radius in (0, 2, 5):
            assert sorted(tree.within(q, radius)) == [i for i, k in enumerate(keys) if (k ^ q).bit_count() <= radius]
    assert list(BKTree().within(1, 3)) == []


def test_search_finds_all_within_the_radius_and_prunes():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(1500)]
    keys = base + [k ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in base[:300]] + base[:50]
    rows = [("s", k, i % 2 if i < 1500 else 0, i, 0) for i, k in enumerate(keys)]
    got = {tuple(sorted((a[0], b[0]))) for a, b in search(rows, 3)}
    want = {(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if rows[i][2] == rows[j][2] and (keys[i] ^ keys[j]).bit_count() <= 3}
    assert got == want
    tree = BKTree()
    for k in keys:
        tree.add(k, k)
    for k in keys:
        list(tree.within(k, 3))
    assert tree.visited < 0.1 * tree.nodes * len(keys)


def test_prefix_filter_loses_nothing():
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    texts = [" ; ".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    texts += [t.replace("wa", "wb", 1) for t in texts]
    sizes, first = prefixes_of(texts, Words({}, 3), 2, 0.7)
    assert sizes.tolist() == [len(shingles(t, 2)) for t in texts]
    first = [set(p.tolist()) for p in first]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(texts[a], texts[b], 2) >= 0.7:
            assert first[a] & first[b]
    assert prefixes_of([], Words({}, 3))[1] == []


@pytest.mark.parametrize("more", ["", " see you at the meeting", " ; greetings from the crane"])
def test_fingerprints_of_like_texts_are_close(more):
    rng = random.Random(9)
    far = 0
    for _ in range(200):
        figure = [str(rng.randint(10, 10**8)) for _ in range(rng.randint(1, 6))]
        a = "add a wall of type solid core on level starting at long and high " + " ".join(figure)
        one, two, other = fingerprints_of([a, a.replace("wall", "wal", 1) + more, a.replace(figure[0], "77")])
        apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
        far += apart(one, two) > 3
        assert len(figure) > 1 or apart(one, other) > 8
    assert far <= 10
