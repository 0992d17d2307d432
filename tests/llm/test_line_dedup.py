"""Repeated lines against brute force."""

import random
import re

from tradewind.llm import line_dedup as x


def plain_units(text, unit="line", least_sentence=1):
    """(first word, end, normalised words) of a text's lines and sentences; for texts too short for windows."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    words = [text[i:j].lower() for i, j in spans]
    out = set()
    for least, parts in ((1, re.finditer(r"[^\n]+" if unit == "line" else r"(?:[^\n]|\n(?!\s*\n))+", text)), (least_sentence, re.finditer(r"(?:[^\n.!?]|[.!?](?![\"]?(?:\s|\Z)))*(?:[.!?][\"]?(?=\s|\Z)|\n|\Z)", text))):
        for m in parts:
            at = [k for k, (i, j) in enumerate(spans) if m.start() <= i and j <= m.end()]
            if at and at[-1] + 1 - at[0] >= least:
                out.add((at[0], at[-1] + 1))
    return [(i, j, " ".join(words[i:j])) for i, j in sorted(out)], spans


def brute(rows, least, unit="line"):
    """Runs of units that stood before in order of id and place, as passages."""
    seen, gone = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found, spans = plain_units(t or "", unit, min(x.SENTENCE, least))
        runs, own = [], {}
        for i, j, norm in found:
            keep = seen.get(norm, d if norm in own else "new")
            own.setdefault(norm, d)
            if keep == "new":
                continue
            if runs and i <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(j, runs[-1][1]), max(j - i, runs[-1][2]), min(keep, runs[-1][3])]
            else:
                runs.append([i, j, j - i, keep])
        gone += [(d, spans[i][0], spans[j - 1][1], j - i, keep) for i, j, n, keep in runs if n >= least]
        for norm in own:
            seen.setdefault(norm, d)
    return sorted(gone, key=repr)


def corpus():
    r = random.Random(2)
    word = lambda: r.choice("Alpha beta Gamma delta eps Zeta".split()) + str(r.randrange(60))
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice([".", "!", "?", '."'])
    shared = [sentence(r.randrange(1, 9)) for _ in range(12)]
    out = []
    for i in range(300):
        lines = [" ".join(r.choice([sentence(r.randrange(1, 8)), r.choice(shared), r.choice(shared).upper().replace(" ", "  ")]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 6))]
        text = "\n\n".join(lines) if i % 3 else "\n".join(lines)
        out.append((1000 - i, " ".join(text.split(" ")[:45])))
    return [*out, (3, None), (4, ""), (5, "\n\n  \n")]


def test_repeats(spark):
    rows = corpus()
    assert all(len((t or "").split()) < x.FOUND for _, t in rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, d0 int").repartition(6)
    for unit, least in (("line", 1), ("line", 7), ("paragraph", 3)):
        got = sorted(((r.doc_id, r.start, r.stop, r.n_words, r.keep_id) for r in x.repeats(docs, least, unit).collect()), key=repr)
        assert len(got) > 10 and got == brute(rows, least, unit)
    assert x.repeats(docs.limit(0)).count() == 0


def test_short_lines_stay_by_default_and_go_by_parameter(spark):
    docs = spark.createDataFrame([(i, f"Unlike the others {i}.\nOne two three four five") for i in range(5)], "doc_id long, text string")
    assert x.repeats(docs).count() == 0
    assert sorted((r.doc_id, r.n_words, r.keep_id) for r in x.repeats(docs, least=1).collect()) == [(i, 5, 0) for i in range(1, 5)]


def test_remove(spark):
    rows = corpus()
    names = "doc_id long, text string, start int, __spans int, __id int, __key int, id int, key int, spans int, n_words int, first int, run int"
    docs = spark.createDataFrame([(*r, *range(10)) for r in rows], names).repartition(6)
    spans = {}
    for d, a, b, *_ in brute(rows, 1):
        spans.setdefault(d, []).append((a, b))
    out = x.remove_repeats(docs, least=1)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {d: t if t is None else x.cut(t, spans.get(d, [])) for d, t in rows}
    assert all(got[d] == t for d, t in rows if d not in spans)
    assert out.schema == docs.schema and out.first()["__spans"] == 1


def test_cut():
    t = "Aa bb. Cc dd.\nEe ff.\n\nGg."
    assert x.cut(t, [(0, 6)]) == "Cc dd.\nEe ff.\n\nGg."
    assert x.cut(t, [(0, 6), (7, 13)]) == "Ee ff.\n\nGg."
    assert x.cut(t, [(14, 20)]) == "Aa bb. Cc dd.\n\nGg."
    assert x.cut(t, [(7, 13)]) == "Aa bb. \nEe ff.\n\nGg."
    assert x.cut(t, [(0, 6), (7, 13), (14, 20), (22, 25)]) == "\n"


def test_ids_that_repeat(spark):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, line), (1, line), (1, "other\n" + line), (2, line + "\n" + line), (None, line)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.start, r.stop) for r in x.repeats(docs, least=9).collect()), key=repr) == [(2, 0, 2 * len(line) + 1), (None, 0, len(line))]


def test_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "x " * 400_000), (2, "x " * 400_000), (3, ""), (4, None), (5, "y" * 3_000_000), (6, "y" * 3_000_000 + " z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words) for r in x.repeats(docs).collect())
    assert got == [(1, 2 * x.WINDOW, 400_000 - x.WINDOW), (2, 0, 400_000)]  # what repeats itself keeps its first window
    assert {r.doc_id: r.text for r in x.remove_repeats(docs).collect()}[2] == ""


def test_any_fifty_words_that_come_back_are_found(spark):
    """Brute force over windows of 50 words (characters without spaces), that doesn't use units()."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    short = lambda n: " ".join(" ".join(word() for _ in range(r.randrange(2, 7))).capitalize() + "." for _ in range(n))
    run = lambda n: " ".join(word() for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    thai = "".join(chr(r.randrange(0xE01, 0xE2F)) for _ in range(60))
    dozen = " ".join(" ".join(word() for _ in range(5)) + "." for _ in range(12))
    shared = [dozen, short(20), run(60), run(50), han(60), thai, "。".join(han(5) for _ in range(12)), "go on. " * 40]
    dense = [False] * 4 + [True] * 3 + [False]
    rows = []
    for s, d in zip(shared, dense, strict=True):
        around = (lambda: han(r.randrange(1, 30))) if d else (lambda: r.choice([run(3) + ".", run(5) + ".", run(9), short(3)]))
        gap = "" if d else " "
        rows += [(10 * len(rows) + k, gap.join([around(), s, around()])) for k in range(4)]
    rows.append((5000, run(300) + " " + short(30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {}
    for g in x.repeats(docs).collect():
        gone.setdefault(g.doc_id, []).append((g.start, g.stop))
        assert g.keep_id <= g.doc_id
    seen, missed, found = set(), 0, 0
    for d, t in rows:
        if any("\u0e00" <= c for c in t):
            spans = [(i, i + 1) for i, c in enumerate(t) if c != "。"]
        else:
            at, spans = 0, []
            for w in t.split():
                at = t.index(w, at)
                spans.append((at, at + len(w)))
                at += len(w)
        mine = set()
        for k in range(len(spans) - 49):
            a, b = spans[k][0], spans[k + 49][1]
            key = " ".join(t[a:b].lower().split())
            if key in seen:
                found += 1
                missed += not any(p < b and q > a for p, q in gone.get(d, []))
            mine.add(key)
        seen |= mine
    assert found > 100 and missed == 0
    assert 5000 not in gone and all(rows[k][0] not in gone for k in range(0, 28, 4))


def test_equal_windows_do_not_overlap():
    u = x.units(["x " * 500, "y z " * 500])
    at = {t: [w for w, n, k in zip(u["word"].tolist(), u["n_words"].tolist(), u["text"].tolist(), strict=True) if k == t and n == x.WINDOW] for t in (0, 1)}
    assert at[0] == [*range(0, 481, x.WINDOW)] and len(at[1]) == 49 or len(at[1]) == 50
    assert all(b - a >= x.WINDOW for a, b in zip(at[1], at[1][1:]))
