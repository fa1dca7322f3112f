import pytest
import random

from pyspark.sql import functions as F

from convolake.functions import text as X

def col():
    return F.col("c")


def test_like_folds_ascii_only_and_keeps_wildcards(rows):
    values = ["Path ABC", "É", "a_c", "a\\d", None]
    assert rows(values, X.like_ci(col(), "abc")) == [True, False, False, False, None]
    assert rows(values, X.like_ci(col(), "é")) == [False, False, False, False, None]
    assert rows(values, X.like_ci(col(), "A_C")) == [True, False, True, False, None]
    assert rows(values, X.like_ci(col(), "A\\D")) == [False, False, False, True, None]


def test_like_literal_turns_wildcards_off(rows):
    assert rows(["abc", "a_c", "100%"], X.like_ci(col(), "A_C", literal=True)) == [False, True, False]
    assert rows(["abc", "100%"], X.like_ci(col(), "0%", literal=True)) == [False, True]


def test_blank_and_strip_cover_all_white_space(rows):
    values = ["\n \t", "", None, " a ", "\n a \t"]
    assert rows(values, X.is_blank(col())) == [True, True, True, False, False]
    assert rows(values, X.strip(col())) == ["", "", None, "a", "a"]


def test_paths_and_flags(rows):
    values = ["see /a/b.c and /x", "/é/ü-1/z", "none", None, "a/b/c"]
    assert rows(values, X.extract_paths(col())) == [["/a/b.c"], ["/é/ü-1/z"], [], None, ["/b/c"]]
    assert rows(values, X.has_paths(col())) == [True, True, False, False, True]
    assert rows(["```x", "``", None], X.has_code(col())) == [True, False, False]


def test_slugs_and_display(rows):
    assert rows(["/a/b c/", "/a/b.c-d", "", None, "/é"], X.project_slug(col())) == [
        "b_c", "b.c-d", "global", "global", "é"]
    assert rows([" Fix: the (Bug)! ", "A  b"], X.title_slug(col())) == ["fix-the-bug.md", "a--b.md"]
    long = "/home/u/" + "x" * 40 + "/y/z"
    assert rows(["/home/u/p", long], X.display_path(col(), "/home/u")) == ["~/p", "…/y/z"]
    assert rows(["/a/b", "", None], X.base_name(col(), "unknown")) == ["b", "unknown", "unknown"]


def test_epoch_date(rows):
    assert rows([1700000000000, 0, None], X.epoch_ms_date(col()), "long") == ["2023-11-14", "", ""]


def test_content_id(rows):
    import hashlib
    want = hashlib.sha256(b"/p:T:s").hexdigest()[:16]
    assert rows(["s"], X.content_id(F.lit("/p"), F.lit("T"), col())) == [want]


CMD, EDIT, OUT = "[cmd] ", "[edit] ", "[output exit=0] "


@pytest.mark.parametrize("text,kept", [
    (None, None),
    ("", ""),
    ("a" * 600, "a" * 600),  # fits as it is
    ("a" * 601, ""),  # one plain line that is too long by itself
    (CMD + "x" * 700, CMD + "x" * 294),  # commands are cut to 300 characters
    (EDIT + "x" * 700 + "\nshort", EDIT + "x" * 293 + "\nshort"),
    (OUT + "o" * 400 + "\n" + "p" * 300, OUT + "o" * 134 + "\n" + "p" * 200),  # output to 150, text to 200
    ("q" * 700 + "\nshort\n" + "r" * 300, "short\n" + "r" * 200),  # what does not fit is passed over
    ("a" * 599 + "\nb", "a" * 200 + "\nb"),
    ("\n".join([CMD + "x" * 290] * 5), "\n".join([CMD + "x" * 290] * 3)),  # 296 and 592 are below the limit, 888 ends it
])
def test_truncate_salient_by_hand(rows, text, kept):
    assert rows([text], X.truncate_salient(col())) == [kept]


def test_truncate_salient_properties(rows):
    rng = random.Random(7)
    kinds = {CMD: 300, EDIT: 300, OUT: 150, "": 200, "é": 200}
    texts = ["\n".join(rng.choice(list(kinds)) + "z" * rng.choice([0, 5, 60, 160, 250, 400]) for _ in range(rng.randrange(1, 15)))
             for _ in range(300)]
    for text, short in zip(texts, rows(texts, X.truncate_salient(col()))):
        if len(text) <= 600:
            assert short == text
            continue
        lines, kept = text.split("\n"), short.split("\n") if short else []
        at = -1  # kept lines are beginnings of lines, in their order
        for line in kept:
            at = next(i for i in range(at + 1, len(lines)) if lines[i].startswith(line) and (len(line) == len(lines[i]) or len(line) >= 150))
        sizes = [len(line) for line in kept]
        assert all(sum(sizes[:i]) < 600 for i in range(len(sizes)))  # nothing is added beyond the limit
        for i, line in enumerate(kept):  # only commands and edits may pass it
            if not line.startswith((CMD, EDIT)):
                assert sum(sizes[: i + 1]) < 600
        spoken = [line for line in lines if line.startswith((CMD, EDIT))]
        if sum(min(300, len(line)) for line in spoken) + sum(sizes) < 600:
            assert all(line[:300] in kept for line in spoken)
