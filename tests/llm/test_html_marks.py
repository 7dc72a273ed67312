"""Marks in attributes: what hides an element, and what only looks like it."""

import pytest

from tabletrail.llm import html_text

TEXT = "words of the text " * 9
PAGE = f"<h1>H</h1><p>{TEXT}</p><p>the rest</p>"
WHOLE = f"H\n{TEXT.strip()}\nthe rest"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article data-title='the hidden valley'>{PAGE}</article></body>",
        f"<body><div class='layout hidden md:block'>{PAGE}</div></body>",
        f"<body><div role=form>{PAGE}</div></body>",
        f"<body><div data-id=comments data-class='sidebar'><article>{PAGE}</article></div></body>",
        f"<body><div hidden><article>{PAGE}</article></div></body>",
        f"<body><div title='style=display:none'><article>{PAGE}</article></div></body>",
        f"<body><article>{PAGE}<p hidden>gone</p><div style='color:red; DISPLAY : none'>gone</div><span aria-hidden = TRUE>gone</span></article></body>",
        f"<body><article>{PAGE}<div role='complementary'>gone</div><button>Share</button></article></body>",
        f"<body><article>{PAGE}<div HIDDEN=''><p>gone</p></div></article></body>",
    ],
)
def test_only_marks_hide_and_never_most_of_the_page(page):
    assert html_text.main_text(page) == WHOLE


def test_words_of_a_sentence_stay():
    page = f"<body><article><h1>H</h1><p>{TEXT}</p><p title='a hidden gem'>see <label>this</label> and <button>b</button></p></article></body>"
    assert html_text.main_text(page) == f"H\n{TEXT.strip()}\nsee this and b"
    form = f"<body><article><h1>H</h1><p>{TEXT}</p><form><label>Mail</label><button>Send</button></form></article></body>"
    assert html_text.main_text(form) == f"H\n{TEXT.strip()}"


def test_attributes_have_names_and_values():
    found = html_text._attributes(""" CLASS="a b" id=x data-id='y' hidden aria-hidden = "true" title="hidden id=z" class=c """)
    assert found == {"class": "a b", "id": "x", "data-id": "y", "hidden": "", "aria-hidden": "true", "title": "hidden id=z"}
