"""Pages written by hand, of layouts that the training rules do not draw. Main blocks begin with a section sign."""

import resource
import time

import pytest

from sensorlab.llm import extraction

LONG = "The council met on Tuesday evening and agreed to repair the bridge before winter, after months of delay."
MORE = "Engineers found cracks in two of the pillars last spring, and traffic has been limited to one lane since."
LAST = "Work begins in September and should end by the first week of November, the mayor said."

PAGES = {
    "bootstrap": f"""<html><head><title>Bridge</title></head><body><div class="navbar"><ul><li><a href="/">Home</a></li>
      <li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></div><div class="container"><div class="row">
      <div class="col-md-8"><h1>§Bridge to be repaired</h1><p>§{LONG}</p><p>§{MORE}</p></div><div class="col-md-4">
      <div class="widget"><h3>Popular</h3><ul><li><a href="/1">Ten best walks</a></li><li><a href="/2">Rain ahead</a></li></ul>
      </div></div></div></div><div class="footer"><p>&copy; 2021 Herald</p></div></body></html>""",
    "plain": f"<body><h1>§Bridge to be repaired</h1><p>§{LONG}</p><p>§{MORE}</p><p>§{LAST}</p></body>",
    "semantic": f"""<body><header><a href="/">Herald</a></header><nav><a href="/a">A</a> <a href="/b">B</a></nav><main><article>
      <h2>§Repair agreed</h2><p>§{LONG}</p><blockquote>§{LAST}</blockquote></article></main><aside><p><a href="/x">Read this too</a></p>
      </aside><footer><p>All rights reserved.</p></footer></body>""",
    "deep": "<body>" + "<div>" * 14 + f"<article><h1>§Repair</h1><p>§{LONG}</p><p>§{MORE}</p></article>" + "</div>" * 14 + "</body>",
    "table": f"""<body><table><tr><td class="menu"><a href="/">Home</a></td><td class="menu"><a href="/n">News</a></td></tr>
      <tr><td><h1>§Bridge</h1><p>§{LONG}</p><p>§{MORE}</p></td></tr></table></body>""",
    "blog": f"""<body><div id="masthead"><h1><a href="/">My days</a></h1></div><div id="main"><div class="entry"><h2>§On bridges</h2>
      <p>§{LONG}</p><ul><li>§Two pillars are cracked and one is bent.</li><li>§One lane is open to traffic.</li></ul><p>§{LAST}</p></div>
      <div id="comments"><h3>2 comments</h3><div class="comment"><p>I use this bridge every day and it shakes a lot.</p></div>
      <div class="comment"><p>About time they did something.</p></div></div></div><div id="footer">Powered by hand</div></body>""",
    "cookie": f"""<body><div class="cookie-consent"><p>We use cookies to improve your visit. By going on you agree to this.</p>
      <button>Accept</button></div><section><h1>§Bridge</h1><p>§{LONG}</p><p>§{MORE}</p></section></body>""",
    "advert": f"""<body><article><h1>§Bridge</h1><p>§{LONG}</p><div class="advertisement"><p>Buy two tyres and get the third for free.</p></div>
      <p>§{MORE}</p><div class="newsletter-signup"><form><label>Your address</label><button>Send</button></form></div><p>§{LAST}</p></article></body>""",
    "sections": f"""<body><section><section><section><h2>§Bridge</h2><p>§{LONG}</p></section><section><h2>§Cost</h2><p>§{MORE}</p></section>
      </section></section><footer><nav><a href="/p">Privacy</a><a href="/i">Imprint</a></nav></footer></body>""",
    "wiki": f"""<body><div id="toc" class="toc"><ul><li><a href="#a">History</a></li><li><a href="#b">Traffic</a></li></ul></div>
      <div id="bodyContent"><p>§{LONG}</p><h2>§History</h2><p>§{MORE}</p><h2>§Traffic</h2><p>§{LAST}</p></div></body>""",
    "sidebar first": f"""<body><div class="sidebar"><h4>Related</h4><p><a href="/1">Older bridges of the county</a></p><p><a href="/2">Tolls</a></p></div>
      <div class="story"><h1>§Bridge</h1><p>§{LONG}</p><p>§{MORE}</p></div></body>""",
    "breadcrumb": f"""<body><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div><div><div><h1>§Bridge</h1>
      <p>§{LONG}</p><p>§{MORE}</p><p>§{LAST}</p></div></div><div class="pagination"><a href="/2">Next</a></div></body>""",
    "search": f"""<body><form role="search"><label>Search</label><input><button>Go</button></form><div class="post-body"><div><h1>§Bridge</h1>
      <div><p>§{LONG}</p></div><div><p>§{MORE}</p></div></div></div></body>""",
    "recipe": f"""<body><header><nav><ul><li><a href="/">Soups</a></li></ul></nav></header><main><h1>§Lentil soup for six</h1><p>§{LAST}</p>
      <h2>§What you need</h2><ul><li>§500 g of red lentils, rinsed twice.</li><li>§Two onions, cut small.</li><li>§A litre of stock.</li></ul>
      <h2>§How to cook it</h2><p>§{LONG}</p></main><footer><p>&copy; The kitchen</p></footer></body>""",
    "promo bar": f"""<body><div class="promo"><p>Subscribe now and save half of the price for a year!</p></div><div class="wrapper"><div class="inner">
      <article><header><h1>§Bridge</h1></header><p>§{LONG}</p><p>§{MORE}</p></article></div></div><div class="related"><p><a href="/1">More on roads</a></p></div></body>""",
}


def test_hand_written_layouts():
    field = extraction.trained_field()
    right = called = there = 0
    for page in PAGES.values():
        wanted = [b.text.startswith("§") for b in extraction.blocks(page)]
        found = extraction.blocks(page.replace("§", ""))
        assert len(found) == len(wanted)
        labels = field.labels(found)
        right += sum(a and b for a, b in zip(labels, wanted))
        called += sum(labels)
        there += sum(wanted)
    assert len(PAGES) == 15
    assert right >= 0.95 * there and right >= 0.95 * called, (right, called, there)


PARTS = (
    "<nav><ul><li><a href=x>Home</a></li><li><a href=x>About us</a></li></ul></nav>",
    f"<h1>Bridge</h1><p>{LONG}</p><p>{MORE}</p>",
    "<footer><p>&copy; 2020 Herald. All rights reserved.</p></footer>",
)


@pytest.mark.parametrize("wrapper", ["div", "section", "article"])
@pytest.mark.parametrize("holder", ["div", "section", "article", "main"])
def test_text_does_not_depend_on_nesting(wrapper, holder):
    field = extraction.trained_field()
    nav, inner, footer = PARTS
    for depth in range(21):
        begin, end = f"<{wrapper}>" * depth, f"</{wrapper}>" * depth
        for page in (
            f"<body>{begin}{nav}<{holder}>{inner}</{holder}>{footer}{end}</body>",
            f"<body>{nav}{begin}<{holder}>{inner}</{holder}>{end}{footer}</body>",
        ):
            assert extraction.main_text(page, field) == f"Bridge\n{LONG}\n{MORE}", depth


@pytest.mark.parametrize(
    "piece",
    ["<div>text here", "<span>x<hr>", "<svg><g>a", "<b></i>", "<p><a>x", "<div><svg></a>", "<ul><li>a", "<table><tr><td>"],
)
def test_unclosed_elements_cost_linear_time(piece):
    field = extraction.trained_field()
    before, begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    extraction.main_text(piece * 40_000, field)
    assert time.monotonic() - begun < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
