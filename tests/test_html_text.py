"""The text of pages against a reader of its own: marks by a pattern, open elements by a list."""

from __future__ import annotations

import hashlib
import html
import re

from tessera.plans import registry
from tessera.sources import loaders

SF = "/root/testdata/sf0.001"
MARK = re.compile(r"""(<!--.*?-->|<![^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>)""", re.S)


def plain_page(page: str) -> tuple[str, str]:
    page = re.sub(r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", r"\1\3", page)
    title, runs, inside = "", [], []
    for part in MARK.split(page):
        if part.startswith("<!"):
            continue
        name = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", part)
        if name is None:
            said = html.unescape(part)
            if "title" in inside:
                title += said
            elif said.strip() and not {"nav", "header", "footer", "aside", "script", "style", "form"} & set(inside):
                runs.append((set(inside), said.strip()))
        elif name[1] and name[2].lower() in inside:
            while inside.pop() != name[2].lower():
                pass
        elif not name[1] and name[2].lower() not in loaders.VOID:
            inside.append(name[2].lower())
    roots = [r for r in ("main", "article", "body") if any(r in x for x, _ in runs)]
    return title.strip(), "\n".join(t for x, t in runs if not roots or roots[0] in x)


def test_page_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    want = {r.page_id: hashlib.sha256(plain_page(r.html or "")[1].encode()).hexdigest() for r in pages}
    assert {r.page_id: r.h for r in registry.QUERIES["html_text"](spark, SF).collect()} == want


def test_page_text_of_odd_pages():
    assert loaders.page_text(None) == loaders.page_text("") == ("", "")
    for page in ("<p>a&amp;b<br>c</p>", "<title>T &lt;</title><body>x<nav>n</nav>y</body>", "<main><p>m</main><article>a</article>", "<article>a<!-- c -->b</article>z", "<ul><li>1<li>2</ul>3"):
        assert loaders.page_text(page) == plain_page(page), page
