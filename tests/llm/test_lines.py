"""Which pairs of lines are verified."""

import random

from quillspark.llm import lines


def test_parities_spare_dissimilar_pairs_of_small_bands(spark, monkeypatch):
    """Lines that are near each other but below the threshold: few of their pairs are joined with the lines' own tables."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") for _ in range(96)]

    def changed():
        line = list(base)
        for k in rng.sample(range(0, 95, 6), 3):
            line[k] = rng.choice("klmnopq")
        return "".join(line)

    texts = [changed() for _ in range(40)]
    sets = [{t[k : k + 5] for k in range(92)} for t in texts]
    like = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    rows, write = {}, lines.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "written", counted)
    _, firsts = lines.linked(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    assert firsts.count() == 40
    assert max(rows.get("across", 0), rows["near"]) <= 1.2 * like, (rows, like)


def test_lines_of_small_bands_need_no_parities(spark, monkeypatch):
    """Dissimilar lines that share bands: their pairs are held against each other by their sketches, with no text fetched for the last join."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(40)]
        for _ in range(4):
            line = list(base)
            for k in rng.sample(range(40), 8):
                line[k] = word()
            texts.append(" ".join(line))
    rows, write = {}, lines.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "written", counted)
    links, firsts = lines.linked(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    assert links.count() == 0 and firsts.count() == len(texts)
    assert rows["shared"] > 60 and rows["left"] == 0, rows


def test_pairs_of_one_component_are_not_verified_again(spark, monkeypatch):
    """Copies that differ a little: each line's likeliest partner joins most, and bands of few lines aren't written again for the second turn."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(30)]
        for _ in range(6):
            line = list(base)
            line[rng.randrange(30)] = word()
            texts.append(" ".join(line))
    texts += ["\x0b \f\t\r", "  ", "f", "\u00a0"]
    rows, write = {}, lines.written

    def counted(df, name):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "written", counted)
    got = sorted(r.doc_id for r in lines.dropped(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect())
    assert got == [k for k in range(150) if k % 6]
    assert rows["firsts"] == [152] and rows["rows"][1:] == [0, 0] and rows["named"] == [150]
    assert sum(sum(rows[n]) for n in ("pairs", "near", "waiting")) <= 250, rows
