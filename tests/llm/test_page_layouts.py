"""Main text of pages written by hand, none of them from the training pages' parts."""

import pytest

from emberlog.llm import html_extract

W = "The council met on Tuesday evening, and after a long debate it voted to repair the old bridge over the river."
V = "Work will begin in spring; until then, drivers are asked to take the road along the mill, which is open to all."
X = "Nobody spoke against the plan, although two members said that the cost, at nearly a million, had not been explained."
PAGES = {
    "bare div": (f"<body><div><p>{W}</p><p>{V}</p></div></body>", [W, V]),
    "misleading class": (f"<div class='notice-board'><p>{W}</p><p>{V}</p></div>", [W, V]),
    "misleading section": (f"<section class='comments-policy'><p>{W}</p><p>{V}</p></section>", [W, V]),
    "table cell": (f"<table><tr><td><p>{W}</p><p>{V}</p></td></tr></table>", [W, V]),
    "closed svg": (f"<article><p>{W}</p><svg viewBox='0 0 1 1'/><p>{V}</p><svg><path d='M0'/></svg><p>{X}</p></article>", [W, V, X]),
    "stray quotes": (f"<article><p title=don't>{W}</p><p class=\"x\"\">{V}</p></article>", [W, V]),
    "open noscript": (f"<article><p>{W}</p><noscript><p>{V}</p>", [W, V]),
    "trailing less-than": (f"<article><p>{W}</p><p>{V}</p> < 5 percent of it, they said", [W, V, "< 5 percent of it, they said"]),
    "cut tag": (f"<article><p>{W}</p><p>{V}</p><div class=", [W, V]),
    "menus and footer": (
        f"<body><div class=navigation><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li><li><a href=/c>Weather</a></li></ul></div><div class=main><p>{W}</p><p>{V}</p><p>{X}</p></div>"
        "<footer>&copy; 2020 The Paper. All rights reserved.</footer></body>",
        [W, V, X],
    ),
    "comments": (f"<article><p>{W}</p><p>{V}</p></article><div id=comments><h3>Comments</h3><div class=comment><b>ann</b><p>I think that this is a very good idea, thank you.</p></div></div>", [W, V]),
    "paragraphs right under the body": (f"<body><p>{W}</p><p>{V}</p></body>", [W, V]),
    "two bare divs": (f"<html><body><div>{W}</div><div>{V}</div></body></html>", [W, V]),
    "three bare divs": (f"<body><div>{W}</div><div>{V}</div><div>{X}</div></body>", [W, V, X]),
    "divs in a wrapper": (f"<body><div class=x7><div>{W}</div><div>{V}</div></div></body>", [W, V]),
    "divs with line breaks": (f"<body><div>{W}<br>{X}</div><div>{V}<br>{W}</div></body>", [f"{W} {X}", f"{V} {W}"]),
    "one bare paragraph": (f"<body><p>{W} {V}</p></body>", [f"{W} {V}"]),
    "heading and bare divs": (f"<body><h1>The bridge over the river</h1><div>{W}</div><div>{V}</div></body>", ["The bridge over the river", W, V]),
    "bare paragraphs between menu and footer": (
        f"<body><nav><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></nav><p>{W}</p><p>{V}</p><footer>&copy; 2020 The Paper. All rights reserved.</footer></body>",
        [W, V],
    ),
    "bare divs between menu and footer": (
        f"<body><div class=menu><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></div><div>{W}</div><div>{V}</div><div class=footer>&copy; 2020 The Paper.</div></body>",
        [W, V],
    ),
    "references": ("<article><p>" + W.replace("old", "&eacute;&#233;&lt;b&gt;") + f"</p><p>{V}</p></article>", [W.replace("old", "éé<b>"), V]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page, want = PAGES[name]
    assert html_extract.main_text(html_extract.trained(), page).split("\n\n") == want


def test_deep_and_long_page():
    page = "<div>" * 2000 + "<article>" + "".join(f"<p>{W} <a href=x>more</a></p>" for _ in range(500))
    assert html_extract.main_text(html_extract.trained(), page).count(W) == 500
