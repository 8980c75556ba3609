"""Ids that are slugs of headings, inside of an article and elsewhere."""

from kinfold.llm import html

PAGE = (
    '<html><body><div id="related">Links</div><article><h1>Graphs</h1><h2 id="search-algorithms">Search algorithms</h2><p>Depth first.</p>'
    '<section id="related-work"><p>Others did it, too.</p></section><div class="box social-impact">It matters.</div>'
    '<div class="ad">Buy</div><div id="comments">Nice</div></article></body></html>'
)


def test_slugs_inside_an_article_are_kept():
    assert html.main_text(html.Page(PAGE)) == "Graphs\nSearch algorithms\nDepth first.\nOthers did it, too.\nIt matters."


def test_names_outside_of_an_article_count_as_wholes():
    body = "<p>Text that goes on for a while here</p>"
    assert html.main_text(html.Page(f'{body}<div id="related">Links</div>')) == "Text that goes on for a while here"
    assert html.main_text(html.Page(f'{body}<div id="related-work">Links</div>')) == "Text that goes on for a while here\nLinks"
