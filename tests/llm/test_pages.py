"""Pages whose articles have names, lists, tables and code that look like other parts of a page."""

import pytest

from aeroframe.llm import html_text

PROSE = "This is a sentence of the article, and it is long enough, so it counts as prose. "


@pytest.mark.parametrize("part", [
    "<section id='discussion'><h2>Discussion</h2><p>{}</p></section>", "<section id='survey-results'><p>{}</p></section>", "<h2 id='related-work'>{}</h2>", "<h2 id='search-for-survivors'>{}</h2>",
    "<h3 id='comments'>{}</h3>", "<div class='share-price'>{}</div>", "<p class='form-factor'>{}</p>", "<section id='survey-results'><p>{}</p><p>{}</p><p>{}</p><button>Show table</button></section>",
])
@pytest.mark.parametrize("frame", ["<article><p>{}</p>{}</article>", "<main><p>{}</p>{}</main>", "<body><div><p>{}</p>{}</div></body>"])
def test_title_words_in_names_leave_nothing_out(part, frame):
    got = html_text.main_text(frame.format(PROSE, part.replace("{}", PROSE)))
    assert got.count("counts as prose") == 1 + part.count("{}")


@pytest.mark.parametrize("part", [
    "<div class='share-links'>Gone</div>", "<div class='related'>Gone <p>Gone</p></div>", "<div id='related-stories'><h3>Gone</h3><ul><li><a href=x>Gone there with this link</a></ul></div>",
    "<div id='search'>Gone <input name=q></div>", "<div class='comments'>Gone</div>", "<div id='comments'><p>Gone, it is.</p></div>", "<a class='share-this' href=x>Gone</a>",
    "<div class='survey-box-top'>Gone <button>Gone</button></div>", "<div id='poll'><div id='related'><a href=x>Gone gone</a></div><input> Gone</div>",
])
def test_other_parts_in_an_article_are_left_out(part):
    assert html_text.main_text(f"<article><p>{PROSE}</p>{part}<p>{PROSE}</p></article>").split() == (PROSE * 2).split()


PARAGRAPHS = "<p>" + "</p><p>".join(["word, " * 65 + "and so on."] * 5) + "</p>"
ITEMS = "<ul>" + "<li>A short item of the list</li>" * 6 + "</ul>"
SENTENCES = "<ol>" + "<li>An item of sixty characters, more or less, with a full stop.</li>" * 12 + "</ol>"
CELLS = "<table>" + "<tr><td>cell 1</td><td>cell 2</td></tr>" * 10 + "</table>"
CODE = "<pre>x = 1</pre>"
LINKS = "<ul>" + "<li><a href=x>Go there</a></li>" * 12 + "</ul>"


@pytest.mark.parametrize("frame", ["<article><h1>Title</h1>{}</article>", "<body><div><h1>Title</h1>{}</div><div>Site name</div></body>", "<body><h1>Title</h1>{}</body>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("part, found, times", [(ITEMS, "A short item of the list", 6), (SENTENCES, "with a full stop", 12), (CELLS, "cell", 20), (CODE, "x = 1", 1), (ITEMS + CELLS + CODE, "cell", 20)])
@pytest.mark.parametrize("times_longer", [1, 3])
def test_short_blocks_between_long_paragraphs_stay(frame, part, found, times, times_longer):
    long = PARAGRAPHS.replace("word, ", "word, " * times_longer)
    got = html_text.main_text(frame.format(long + part + long + LINKS + part))
    assert got.count(found) == 2 * times and got.count("and so on.") == 10 and "Go there" not in got and "Site name" not in got
    assert got.index(found) > got.index("and so on.") and got.rindex(found) > got.rindex("and so on.")


def test_linked_cells_of_a_text_table_stay():
    table = "<table>" + "<tr><td><a href=x>name</a></td><td>what the name means</td></tr>" * 6 + "</table>"
    assert html_text.main_text(f"<article>{PARAGRAPHS}{table}{PARAGRAPHS}</article>").count("name") == 12
