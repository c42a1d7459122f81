import pytest

from gistra.llm import html as X

LONG = [f"Sentence number {k} of the page itself, which is long enough to be told from a link or a teaser." for k in range(8)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
TEASERS = "".join(f"<article><a href=/{k}><h3>Read {k}</h3></a><a href=/{k}>more</a></article>" for k in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class=content>{BODY}</div><section>{TEASERS}</section></body>",
        f"<body><div class='layout has-sidebar'><div>{BODY}</div><div class=sidebar><p>aside</p></div></div></body>",
        f"<body><nav><a>Home</a></nav><div id='with-comments'><article>{BODY}</article><div class=comments><p>first!</p></div></div><footer>F</footer></body>",
        f"<body><article class='post-header'>{BODY}</article><div class='cookie-notice'><p>ok?</p></div></body>",
    ],
)
def test_main_text_by_ratio(page):
    assert X.extract(page) == "\n\n".join(LONG)
