import random

from siteloom.llm import licenses

from .test_dedup import table


def slow(text, sets, threshold=licenses.THRESHOLD):
    found = {}
    for line in (text or "").split("\n"):
        own = set(licenses.words(line))
        for name, t in sets.items():
            c = len(own & t) / len(t)
            if c >= threshold - 1e-12:
                found[name] = max(c, found.get(name, 0))
    return found


def test_filters_lose_nothing():
    rng = random.Random(4)
    for threshold in (0.3, 0.5, 0.8, 1.0):
        sets = {f"t{i}": frozenset(b"w%d" % rng.randrange(30) for _ in range(rng.randrange(1, 14))) for i in range(12)}
        scanner = licenses.Scanner(sets, {b"w%d" % i: rng.randrange(5) for i in range(25)}, threshold)
        for _ in range(300):
            block = [b"w%d" % rng.randrange(40) for _ in range(rng.randrange(0, 25))]
            own = set(block)
            want = {n: len(own & t) / len(t) for n, t in sets.items() if len(own & t) / len(t) >= threshold - 1e-12}
            assert scanner.matches(block) == want


def test_phrases():
    assert licenses.phrases([b"cc", b"by", b"cc", b"by", b"x", b"cc"]) == ([0, 2], {"cc-by"})
    assert licenses.phrases([]) == ([], set())


def test_scan(spark):
    texts = [None, "", "x\nReleased under the MIT License.\ny", "ALL RIGHTS, reserved! cc-by CC by", "Licensed under cc by 4.0", "é General Public  License", "word " * 3000 + "\nlicensed UNDER the apache license version 2"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    sets = licenses.template_sets()
    for i, t in enumerate(texts):
        found = slow(t, sets)
        assert got[i].score == max(found.values(), default=0)
        assert set(filter(None, got[i].labels.split(","))) == set(filter(None, got[i].base_labels.split(","))) | found.keys()
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert got[0].first_word is None and got[0].base_labels == "" and "mit" in got[2].labels.split(",") and got[5].base_labels == "gpl"
    assert licenses.scan(table(spark, [])).count() == 0


def test_wrapped_notices_match_over_line_ends(spark):
    names, texts = sorted(licenses.TEMPLATES), []
    for lead in ("", "# ", " * "):
        for n in names:
            ws = licenses.TEMPLATES[n].split()
            half = len(ws) // 2
            texts.append(f"{lead}before it\n{lead}{' '.join(ws[:half])}\n{lead}{' '.join(ws[half:])}\n{lead}after it")
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i in range(len(texts)):
        assert got[i].score == 1 and names[i % len(names)] in got[i].labels.split(",")


def test_windows_lose_nothing():
    rng = random.Random(5)
    sets = {f"t{i}": frozenset(b"w%d" % rng.randrange(30) for _ in range(rng.randrange(2, 14))) for i in range(12)}
    scanner = licenses.Scanner(sets, {b"w%d" % i: rng.randrange(5) for i in range(25)}, 0.8)
    for _ in range(300):
        flat = [b"w%d" % rng.randrange(40) for _ in range(rng.randrange(0, 80))]
        want = {}
        for n, t in sets.items():
            width = len(t) + len(t) // 2
            c = max(len(set(flat[i : i + width]) & t) / len(t) for i in range(len(flat) + 1))
            if c >= 0.8 - 1e-12:
                want[n] = c
        assert scanner.wrapped(flat) == want


def test_whole_license_texts_wrapped_and_changed(spark):
    rng, texts, names = random.Random(7), [], sorted(licenses.TEXTS)
    for name in names:
        ws = licenses.TEXTS[name].split()
        for lost in (0, len(ws) // 20):
            own = list(ws)
            for _ in range(lost):
                own[rng.randrange(len(own))] = "other"
            lines = [" * " + " ".join(own[i : i + 9]) for i in range(0, len(own), 9)]
            texts.append("int main() {}\n/*\n" + "\n".join(lines) + "\n */\nint rest;")
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i in range(len(texts)):
        assert names[i // 2] in got[i].labels.split(",") and got[i].score >= 0.8
    clean = licenses.scan(table(spark, ["the software is what we use and the copyright of this notice is not in any way our own " * 40])).first()
    assert not set(clean.labels.split(",")) & set(names)
