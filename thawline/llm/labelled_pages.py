"""Labelled pages for training main-text extraction: layouts written by hand for this library.

``data-y`` gives the label of an element and of all below it until another one: 1 for the article and what holds it,
0 for everything around it. PARAS, MIDS, LINES and ITEMS stand for paragraphs, middling ones, short ones and list items, LOREM for running text,
MEDIUM for a sentence or two, SHORT for a few words.
"""

from __future__ import annotations

LAYOUTS = (
    """<html data-y=1><body><header data-y=0><h1>SHORT</h1><a href=x>SHORT</a></header><main><article><h1>SHORT</h1>PARAS<ul><li>SHORT</li><li>LOREM</li></ul>
    <p>LOREM</p></article></main><aside data-y=0><h3>SHORT</h3><ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ul></aside><footer data-y=0><p>SHORT</p></footer></body></html>""",
    """<html data-y=1><body><div id="header" data-y=0><div class="menu"><a href=x>SHORT</a><a href=x>SHORT</a></div></div><div id="content"><h2>SHORT</h2>PARAS
    <blockquote>LOREM</blockquote><p>SHORT</p></div><div class="sidebar" data-y=0><p>MEDIUM</p><p><a href=x>SHORT</a></p></div><div id="footer" data-y=0><p>SHORT</p></div></body></html>""",
    """<html data-y=1><body><div class="cookie-notice" data-y=0><p>MEDIUM</p><button>SHORT</button></div><div class="wrapper"><div class="post-body"><h1>SHORT</h1>PARAS
    <table><tr><td>SHORT</td><td>SHORT</td></tr></table></div><section id="comments" data-y=0><h3>SHORT</h3><div class="comment"><p>MEDIUM</p></div><article class="comment"><p>MEDIUM</p></article></section></div></body></html>""",
    """<html data-y=1><body><form action=x data-y=0><label>SHORT</label><input><select><option>SHORT</option></select><button>SHORT</button></form><div role="navigation" data-y=0><a href=x>SHORT</a></div>
    <section><h1>SHORT</h1>PARAS<pre>LOREM</pre><p>LOREM</p></section><div class="newsletter signup" data-y=0><p>SHORT</p><form><input></form></div><footer data-y=0><ul><li><a href=x>SHORT</a></li></ul></footer></body></html>""",
    """<html data-y=1><body><div class="banner promo" data-y=0><p>SHORT</p></div><div class="entry-content">PARAS<figure><figcaption>SHORT</figcaption></figure><p>LOREM</p><div class="advert" data-y=0><p>MEDIUM</p></div>
    <p>LOREM</p><ol><li>SHORT</li></ol></div><div class="related-links" data-y=0><ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ul></div></body></html>""",
    """<html data-y=1><body>PARAS<p>SHORT</p><div>LOREM</div><h2>SHORT</h2>PARAS</body></html>""",
    """<html data-y=1><body><nav data-y=0><p>SHORT</p><div><a href=x>SHORT</a></div></nav><article><header><h1>SHORT</h1></header><h2>SHORT</h2><section>PARAS</section><div><p>LOREM</p></div>
    <aside data-y=0><p>MEDIUM</p></aside><form data-y=0><p>SHORT</p></form><footer data-y=0><p>SHORT</p></footer></article><div class="comments" data-y=0><ul><li><p>MEDIUM</p></li><li>MEDIUM</li></ul></div></body></html>""",
    """<html data-y=1><body><div id="nav" data-y=0><ul><li><a href=x>SHORT</a></li></ul></div><main><h1>SHORT</h1><dl><dt>SHORT</dt><dd>LOREM</dd></dl>PARAS<p>LOREM</p></main>
    <div class="legal notice" data-y=0><p>MEDIUM</p></div><div class="sponsored ads" data-y=0><div>SHORT</div></div></body></html>""",
    """<html data-y=1><body><header data-y=0>MEDIUM</header><div class="ad" data-y=0>MEDIUM</div><article><h1>SHORT</h1>PARAS<ol><li>SHORT</li><li>MEDIUM</li><li>LOREM</li><li>SHORT</li></ol>
    <p>LOREM</p></article><div class="notice" data-y=0>MEDIUM</div><aside data-y=0>MEDIUM</aside><div class="comment" data-y=0>LOREM</div><footer data-y=0>LOREM</footer></body></html>""",
    """<html data-y=1><body><div class="top-menu" data-y=0>SHORT</div><div class="article"><h2>SHORT</h2>LOREM<ul><li>MEDIUM</li><li>SHORT</li></ul><p>MEDIUM</p></div>
    <div class="widget" data-y=0>LOREM</div><form data-y=0>MEDIUM</form><div class="footer" data-y=0>MEDIUM</div></body></html>""",
    """<html data-y=1><body><div class="nav" data-y=0><a href=x>SHORT</a><a href=x>SHORT</a></div><main><h1>SHORT</h1><ul>ITEMS</ul><div>LINES</div></main><aside data-y=0>MEDIUM</aside></body></html>""",
    """<html data-y=1><body><header data-y=0>SHORT</header><article><h1>SHORT</h1><p>LOREM</p></article><div class="ads" data-y=0><p>MEDIUM</p></div><footer data-y=0>SHORT</footer></body></html>""",
    """<html data-y=1><body><header data-y=0><div>SHORT</div><nav><a href=x>SHORT</a><a href=x>SHORT</a></nav></header><main><article><header><h1>SHORT</h1><p>SHORT</p></header>PARAS<noscript>SHORT</noscript>
    <template data-y=0><p>SHORT</p></template></article><h2 data-y=0>SHORT</h2><ol class="comment-list" data-y=0><li><p>MEDIUM</p></li><li><p>SHORT</p></li></ol></main><footer data-y=0><nav><a href=x>SHORT</a></nav><p>SHORT</p></footer></body></html>""",
    """<html data-y=1><body><noscript data-y=0><p>SHORT</p></noscript><div class="page"><div class="entry"><h1>SHORT</h1>LINES<h2>SHORT</h2>PARAS<h3 data-y=0>SHORT</h3><div class="reply" data-y=0><p>MEDIUM</p></div>
    <h4 data-y=0>SHORT</h4><form class="respond" data-y=0><label>SHORT</label><textarea></textarea></form></div><div class="share" data-y=0><a href=x>SHORT</a></div></div><div class="gdpr" data-y=0>MEDIUM</div></body></html>""",
    """<html data-y=1><body><header data-y=0>SHORT</header><main><article><h1>SHORT</h1>LINES</article></main><aside data-y=0><p>SHORT</p></aside><footer data-y=0><p>SHORT</p></footer></body></html>""",
    """<html data-y=1><body><div class="toolbar" data-y=0><ul><li><a href=x>SHORT</a></li></ul></div><article class="story"><h2>SHORT</h2>LINES<p>MEDIUM</p>LINES</article><div class="links" data-y=0><a href=x>SHORT</a></div></body></html>""",
    """<html data-y=1><body><div class="masthead" data-y=0>SHORT</div><main><article><h1>SHORT</h1>MIDS<ul><li>MEDIUM</li></ul></article></main><div class="disclaimer" data-y=0>MEDIUM</div><div class="sponsor" data-y=0><p>SHORT</p></div></body></html>""",
    """<html data-y=1><body><nav data-y=0><a href=x>SHORT</a></nav><div class="page-content"><h1>SHORT</h1>MIDS<h2>SHORT</h2>MIDS</div><aside data-y=0><h4>SHORT</h4><p>MEDIUM</p></aside><footer data-y=0>SHORT</footer></body></html>""",
    """<html data-y=1><body><header data-y=0><a href=x>SHORT</a></header><nav data-y=0><a href=x>SHORT</a><a href=x>SHORT</a></nav><main><article><h1><a href=x>SHORT</a></h1>PARAS<ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li>
    <li><a href=x>SHORT</a></li></ul><p>LOREM</p><p><a href=x>MEDIUM</a></p><figure><figcaption>SHORT<a href=x>SHORT</a></figcaption></figure><noscript><p>SHORT</p></noscript><form data-y=0><label>SHORT</label><input><button>SHORT</button></form><div class="share" data-y=0><a href=x>SHORT</a></div></article></main><footer data-y=0><p>SHORT</p></footer></body></html>""",
    """<html data-y=1><body><div class="topbar" data-y=0><a href=x>SHORT</a></div><div class="post"><h2><a href=x>SHORT</a></h2>MIDS<h3><a href=x>SHORT</a></h3><p>LOREM</p><table><tr><td><a href=x>SHORT</a></td><td><a href=x>SHORT</a></td></tr>
    <tr><td><a href=x>SHORT</a></td><td>SHORT</td></tr></table><p><a href=x>SHORT</a></p><p>LOREM</p><form data-y=0>SHORT<input></form></div><form data-y=0><p>SHORT</p><select><option>SHORT</option></select></form><div class="related" data-y=0><h3>SHORT</h3><ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ul></div><div id="footer" data-y=0><a href=x>SHORT</a></div></body></html>""",
    """<html data-y=1><body><article><h1>SHORT</h1><p>MEDIUM</p><p><a href=x>MEDIUM</a></p><p>MEDIUM</p></article></body></html>""",
    """<html data-y=1><body><main><h1>SHORT</h1><p>SHORT</p><p><a href=x>SHORT</a></p><p>SHORT</p><figure><figcaption><a href=x>SHORT</a></figcaption></figure><ol><li><a href=x>MEDIUM</a></li><li>MEDIUM</li></ol></main></body></html>""",
    """<html data-y=1><body><section><h1>SHORT</h1><p>MEDIUM</p><p>SHORT</p></section></body></html>""",
    """<html data-y=1><body><div><h1>SHORT</h1><p>MEDIUM</p></div></body></html>""",
    """<html data-y=1><body><nav data-y=0><a href=x>SHORT</a></nav><article><h1>SHORT</h1>MIDS<h2>SHORT</h2><ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ul>
    <p>LOREM</p><ol><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ol></article><div class="comments" data-y=0><div class="comment"><p>LOREM</p></div><div class="comment"><p>LOREM</p></div><div class="comment"><p>LOREM</p><p>LOREM</p><p>LOREM</p></div></div></body></html>""",
    """<html data-y=1><body><div id="header" data-y=0><ul><li><a href=x>SHORT</a></li></ul></div><div id="content"><h1><a href=x>SHORT</a></h1><p>LOREM</p><p>MEDIUM</p><ul><li><a href=x>SHORT</a></li><li><a href=x>SHORT</a></li></ul><h2>SHORT</h2><p>LOREM</p>
    <ul><li><a href=x>SHORT</a>MEDIUM</li><li><a href=x>SHORT</a>MEDIUM</li></ul><aside data-y=0><ul><li><a href=x>SHORT</a></li></ul></aside></div><div class="sidebar" data-y=0><ul><li><a href=x>SHORT</a></li></ul></div></body></html>""",
)

SHORT = "A few words here"
MEDIUM = "All through that spring the river kept its level and the people of the lower town went on with their work. "
LOREM = MEDIUM * 3
PARAS = "<p>LOREM</p><p>MEDIUM</p><p>LOREM</p><p>SHORT</p><p>LOREM</p><p>LOREM</p>"


def pages() -> list[str]:
    out = []
    for x in LAYOUTS:
        for name, text in (("LINES", "<p>SHORT</p>" * 12), ("MIDS", "<p>MEDIUM</p>" * 6), ("ITEMS", "<li>SHORT</li><li>MEDIUM</li>" * 3), ("PARAS", PARAS), ("LOREM", LOREM), ("MEDIUM", MEDIUM), ("SHORT", SHORT)):
            x = x.replace(name, text)
        out.append(x)
    return out
