import json
import random

import pytest

from driftline.llm import spam

PROSE = "The second plot still needs a closer look because the sensors were moved in spring. It grows slowly with the window."
CODE = "import pandas as pd\ndf = pd.read_csv('a.csv', parse_dates=['ts'])\nprint(df.head(5))\nax = df.plot(x='ts', y='level')\n"
LOG = "\n".join(f"step {i}  loss=0.{i:05d}  rate=1.0e-04" for i in range(60))
RETRY = "\n".join("retry fetch in 12s" for _ in range(80))
TABLE = "\n".join(f"{i}    {i * 1.5:.3f}    {i * 2.25:.3f}" for i in range(40))
rnd = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "tu", "sa") for b in ("bon", "ler", "dis", "wan") for c in ("o", "a", "em", "it")]
WORDLIST = "\n".join(rnd.sample(WORDS, 80))
REFERENCES = "\n".join(f"- [{w}](https://docs.{w}.example/{w})" for w in rnd.sample(WORDS, 12))
KEYS = ["cheap phone case", "phone case sale", "best desk lamp", "desk lamp", "buy phone case online"]


def keywords(sep, n=150):
    r = random.Random(1)
    return sep.join(r.choice(KEYS) for _ in range(n))


SPAM = {
    "separated": keywords(" • "),
    "commas": keywords(", "),
    "lines": keywords("\n"),
    "false sentences": keywords(". "),
    "no separators": keywords(" "),
    "links": "\n".join(f"https://shop.{w}.example/{w}?ref={w}" for w in WORDS),
    "anchors": "\n".join(f'<a href="http://{w}.test/x">cheap lamp</a><br>' for w in WORDS),
    "bare links": "\n".join(f"{w}.example/{w}" for w in WORDS),
    "tags": " | ".join(f"tag:{w}" for w in WORDS),
    "hashtags": " ".join(f"#{w}lamp" for w in WORDS),
    "attributes": ";".join(f"brand={w}" for w in WORDS),
    "blank-separated attributes": " ".join(f"{k}={w}" for w, k in zip(WORDS, ["size", "brand", "color"] * 40)),
    "articles": " ".join(f"desk lamp {w.upper()}-{i + 1000}" for i, w in enumerate(WORDS)),
    "invisible": keywords(", ").replace("phone", "ph​one"),
    "unspaced script": " ★ ".join(random.Random(2).choice(["激安携帯ケース", "携帯ケース", "送料無料携帯ケース"]) for _ in range(90)),
}
FINE = {
    "notebook": "\n\n".join([PROSE] * 3) + "\n" + CODE,
    "log": PROSE + "\n" + CODE + LOG,
    "repeated lines": PROSE + "\n" + CODE + RETRY,
    "traceback": PROSE + "\n" + CODE + "\n".join(f'  File "<cell {i}>", line {i}, in {w}\n    {w} = frame[{w}]' for i, w in enumerate(WORDS)) + "\nKeyError: 'x'",
    "table": PROSE + "\n" + CODE + TABLE,
    "word list": PROSE + "\n" + CODE + WORDLIST,
    "references": "\n\n".join([PROSE] * 16) + "\n" + CODE + REFERENCES,
    "blank": " \n\t\n",
    "empty": "",
    "null": None,
    "one word": "word",
    "numbers": "1 2 3\n" * 50,
    "image": PROSE + "\ndata:image/png;base64," + "iVBORw0KGgo" * 900,
}


def notebook(text, where):
    cell = {"cell_type": "code", "source": ["print(1)"], "outputs": []}
    if where == "markdown":
        cell = {"cell_type": "markdown", "source": text.splitlines(keepends=True)}
    elif where == "output":
        cell["outputs"] = [{"output_type": "stream", "text": [text]}]
    return json.dumps({"cells": [cell], "nbformat": 4})


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    text = SPAM[name]
    assert spam.spam_share(text) > 0.6
    assert spam.spam_share("# Title\n\n" + PROSE + "\n" + text) > 0.4
    assert spam.spam_share("# %% [markdown]\n" + "\n".join("# " + x for x in text.split("\n"))) > 0.6
    for where in ("markdown", "output"):
        assert spam.spam_share(notebook(text, where)) > 0.6


@pytest.mark.parametrize("name", FINE)
def test_no_spam(name):
    text = FINE[name]
    assert spam.spam_share(text) < 0.3
    if text:
        assert spam.spam_share(notebook(text, "markdown")) < 0.3


@pytest.mark.parametrize("text", ['{"cells": [', '{"cells": 5}', '{"cells": [5, null, {"source": 7, "outputs": 3}]}', "{}", "{" * 5000, '{"cells": [{"outputs": [null, {"data": {"text/plain": 4}}]}]}'])
def test_broken_notebooks(text):
    assert spam.spam_share(text) < 0.3


def test_table(spark):
    rows = [(i, t, 1.0) for i, t in enumerate([*SPAM.values(), *FINE.values()])]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, spam_share double")
    got = sorted(r.doc_id for r in spam.spam_pages(df).collect())
    assert got == sorted([0, *range(len(SPAM))])
    assert spam.spam_pages(df.limit(0)).collect() == []


def test_planted_among_notebooks_have_a_wide_margin():
    assert min(spam.spam_share(t) for t in SPAM.values()) - max(spam.spam_share(t) for t in FINE.values()) > 0.3


def test_many_shapes_are_no_listing():
    """The decision rests on few shapes: the same lines lumped into one shape would be flagged."""
    r = random.Random(5)
    lines = []
    for _ in range(12):
        for n in (1, 2, 4, 9):
            for case in (str.lower, str.upper, str.title, lambda v: v.title()[:-1] + v[-1].upper()):
                for k in range(max(1, 9 // n)):
                    lines.append(case(" ".join(r.choice(["lamp", "case", "phone", "desk", "sale"]) for _ in range(n))))
    text = "\n".join(lines) + "\n" + "\n".join([PROSE] * 40)
    total, found = spam.shapes(text)
    listed = [g.amount for k, g in found.items() if spam.is_listing(k, g)]
    assert len(listed) > 12
    assert spam.spam_share(text, few=4) < spam.SHARE < sum(listed) / total


def test_words_of_a_shape_decide_together():
    """A line that would pass by itself goes with the lines of its shape."""
    one = spam.Group(amount=10, lines=1, words=2, known=1)
    many = spam.Group(amount=100, lines=10, words=20, known=4)
    shape = (2, 0, 0, 0, "none", False, "short")
    assert spam.is_listing(shape, one)
    assert not spam.is_listing(shape, many)


ODD = ["", "a", "Élan d'été", "l’été ''x", "क्या है", "שָׁלוֹם", "携帯ケース sale", "² Ⅳ ß ſ", "x_y z1", "a  b", "a  b", "a　 \tb", "a \t\t- y", "x, - b", "a - b * c", "a   b", "p #t q", "p k=v q:w", "a • b/c", "a-b", "x 1.5", "x 0.125", "f (x)", "f(x)", "ab [c", "[a: b", "[ab]", "a | -3", "a |", "@x", "mail@x", "is:", "is: it", "50%", "50%%", "a `b`", "```", "\\alpha", "\\A", '"q", r', '"q"', "x = 1", "x =1", "a::b", "a <- b", "a  b7", "a  b", "http://x.io/a", "HTTPS://X.IO", "ftp://x", "://", "www.x.com", "WWW.X.COM", "WWW.X.COM/a", "x.org/p q.ſe/r", "x/y", "1/2", "a.b/"]


def test_shortcuts_agree_with_the_patterns():
    r = random.Random(7)
    texts = ODD + [" ".join(r.choices(ODD, k=r.randint(2, 12))).strip() for _ in range(3000)]
    plain = spam.re.compile(rf"(?:[^\W\d_]|[{spam.MARKS}'’])+")
    assert sum(spam._symbols(t) > 0 for t in texts) > 1000
    for t in texts:
        low = t.lower()
        assert spam._pieces(t) == [p for p in (s.strip() for s in spam.SEPARATOR.split(t)) if p]
        assert (spam._symbols(t) > 0) == (spam.SYMBOLS.search(t) is not None)
        if t.count(" ") + t.count("\\t") > spam.SYMBOL_WORDS:
            assert spam._symbols(t) == len(spam.SYMBOLS.findall(t))
        assert spam._links(t) == (len(spam.LINK.findall(t)) if "/" in t or "www." in t else 0)
        if not spam.UNSPACED.search(t):
            assert spam.words_of(low) == plain.findall(low)


def test_separators_with_blanks():
    """The look ahead of SEPARATOR changes no cut."""
    r = random.Random(8)
    plain = spam.re.compile(spam.SEPARATOR.pattern.partition("])(?:")[2][:-1])
    for _ in range(3000):
        t = "".join(r.choices([" ", "\t", " ", "-", "*", "a", "b1", "#", ":", "=", ",", "•", "é", "/"], k=r.randint(1, 20)))
        assert spam.SEPARATOR.split(t) == plain.split(t)


def test_encoded_runs_and_line_ends():
    """Encoded data counts for nothing, wherever it stands in a line; all line ends cut."""
    run = "aGVsbG8+/w" * 6
    assert spam.shapes(f"x {run} y\r\n{run}\rz {run[:59]}\n")[0] == 2 + 60


def test_costly_patterns_see_few_lines(monkeypatch):
    """Lines that hold no sign of a pattern never reach it, so that a page of plain lines costs little."""
    seen = []

    class Watched:
        def __init__(self, pattern):
            self.pattern = pattern

        def __getattr__(self, name):
            seen.append((self.pattern.pattern, name))
            return getattr(self.pattern, name)

    for name in ("ENCODED", "LINK", "SEPARATOR", "SYMBOLS"):
        monkeypatch.setattr(spam, name, Watched(getattr(spam, name)))
    assert spam.spam_share("\n".join([PROSE] * 40) + "\nand/or\nprint(df)\nfit(a, b)\n" + WORDLIST) < 0.3
    assert seen == []
    assert spam.spam_share("\n".join(f"https://{w}.example/{w} x = {'A' * 60}\n{w}, {w} " + "of it " * 10 for w in WORDS)) > 0.1
    assert len(set(seen)) >= 4
