import random
import re

import pytest

from quern.sources import layout

WORDS = "document string, page int, height double, x0 double, top double, text string"
CJK = re.compile("[⺀-鿿豈-﫿＀-￯]")


def machine(words):
    """Word by word, with a mode, one column after the other."""
    join = lambda a, b: b if not a else a if not b else a + b if CJK.search(a[-1]) or CJK.search(b[0]) else a + " " + b
    tidy = lambda s: re.sub(r"\s{2,}", " ", re.sub(r"(?<=[一-鿿])\s+(?=[一-鿿])", "", s)).strip()
    out, columns = [], {}
    for doc, page, height, x0, top, text in words:
        if x0 is not None and top is not None and text is not None and 42 < top < height - 46:
            columns.setdefault((doc, page, "left" if x0 < 292 else "right"), {}).setdefault(round(top / 3.0), []).append((x0, text))
    for at, rows in columns.items():
        edge, mode, found = min(x for r in rows.values() for x, _ in r), None, []
        for k in sorted(rows):
            row, text = sorted(rows[k]), ""
            for _, w in row:
                text = join(text, w)
            text = text.strip()
            begin, option = re.match(r"\(([A-D])\)\s*(\d{1,3})\s*[.、]\s*(.*)$", text, re.S), re.match(r"\(([A-D])\)\s*(.*)$", text, re.S)
            if not text or re.fullmatch("-{5,}", text):
                continue
            if begin:
                found.append([begin[1], int(begin[2]), begin[3].strip(), [], []])
                mode = "stem"
            elif not found:
                continue
            elif option:
                found[-1][3].append([option[1], option[2].strip()])
                mode = "option"
            elif mode == "stem":
                found[-1][2] = join(found[-1][2], text)
            elif mode == "option" and row[0][0] > edge + 8:
                found[-1][3][-1][1] = join(found[-1][3][-1][1], text)
            else:
                found[-1][4].append(text)
                mode = "note"
        out += [(*at, n + 1, a, no, tidy(stem), [(k, tidy(t)) for k, t in opts], tidy(" ".join(note))) for n, (a, no, stem, opts, note) in enumerate(found)]
    return sorted(out, key=str)


def read(spark, words):
    got = layout.questions(spark.createDataFrame(words, WORDS)).collect()
    return sorted((tuple(r[:7]) + ([tuple(o) for o in r["options"]], r["note"]) for r in got), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_state_machine(spark, seed):
    rng, words = random.Random(seed), []
    for doc in range(3):
        for page in range(1, 4):
            for column in (40.0, 300.0):
                for line in range(rng.randint(0, 30)):
                    top = 30.0 + 13 * line + rng.choice([0, 0.4, 1.5])
                    text = rng.choice([f"({rng.choice('ABCD')}) {rng.randint(1, 99)}. the stem", f"({rng.choice('ABCD')}) an option", f"({rng.choice('ABCD')})選項 文字", "goes on here", "中文 續行", "------", "(E) no", "(A) 3、題", "  "])
                    x = column + rng.choice([0, 0, 5, 9, 20])
                    for n, w in enumerate(text.split() or [" "]):
                        words.append((f"d{doc}", page, 420.0, x + 30 * n, top, w))
    words += [("d0", 1, 420.0, None, 100.0, "lost"), ("d0", 1, 420.0, 50.0, 100.0, None), ("d0", 1, 420.0, 50.0, None, "lost")]
    rng.shuffle(words)
    assert read(spark, words) == machine(words) and len(machine(words)) > 10


def test_notes_and_columns(spark):
    lines = [(40, "(C) 7. What is"), (40, "meant by it?"), (40, "(A) one"), (55, "and more"), (40, "(B) two"), (40, "Note: because"), (55, "of this"), (40, "(C) three")]
    words = [("d", 1, 800.0, float(x), 60.0 + 12 * i, t) for i, (x, t) in enumerate(lines)] + [("d", 1, 800.0, 300.0, 60.0, "goes on in no question"), ("d", 1, 800.0, 300.0, 72.0, "(A) 8、淨 零"), ("d", 1, 800.0, 310.0, 84.0, "排放")]
    assert read(spark, words) == [("d", 1, "left", 1, "C", 7, "What is meant by it?", [("A", "one and more"), ("B", "two"), ("C", "three")], "Note: because of this"), ("d", 1, "right", 1, "A", 8, "淨零排放", [], "")]


def test_nothing(spark):
    assert read(spark, []) == [] and read(spark, [("d", 1, 800.0, 40.0, 10.0, "(A) 1. header"), ("d", 1, 800.0, 40.0, 790.0, "(A) 2. footer"), ("d", 1, 800.0, 40.0, 100.0, "no question")]) == []
