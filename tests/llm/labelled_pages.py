"""Pages of unlike layouts with their main text, labelled by hand."""

PAGES: list[tuple[str, str]] = [
    (  # div soup, names in other words
        """<html><head><title>x</title></head><body><div id="top"><div class="logo">River Times</div><div class="nav-wrap"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div></div>
<div id="wrap"><div class="col-left"><div class="entry"><h2>Bridge opens after nine years</h2><div class="meta">By Jo Hart, 4 May</div><div>The old bridge over the river has been opened again, nine years after the flood that closed it.</div>
<div>People walked across it all morning. &ldquo;I had nearly forgotten the view,&rdquo; said one of them.</div><div>Cars will follow in June.</div></div></div>
<div class="col-right"><div class="box"><h4>Most popular</h4><a href="/1">Ten gardens to see this spring</a><a href="/2">Mayor says no</a></div></div></div><div id="bottom">&copy; River Times. All rights reserved.</div></body></html>""",
        "Bridge opens after nine years\nThe old bridge over the river has been opened again, nine years after the flood that closed it.\nPeople walked across it all morning. “I had nearly forgotten the view,” said one of them.\nCars will follow in June.",
    ),
    (  # comments inside the article
        """<body><header><h1>Garden notes</h1><nav><ul><li><a href=/>Start</a><li><a href=/a>All notes</a></ul></nav></header><main><article><h1>Moving a rose</h1><p>Roses can be moved in late autumn, once the leaves are down.<p>Dig wide, not deep, and keep the roots wet.
<ul><li>Cut it back to a hand's breadth.</li><li>Water it for a week.</li></ul><section class="comments"><h3>2 comments</h3><div class="comment"><b>Lee</b><p>I moved mine in May and it lived, but only just.</p></div><div class="comment"><b>Ada</b><p>Thank you for this!</p></div></section></article></main><footer>Written by hand.</footer></body>""",
        "Moving a rose\nRoses can be moved in late autumn, once the leaves are down.\nDig wide, not deep, and keep the roots wet.\nCut it back to a hand's breadth.\nWater it for a week.",
    ),
    (  # a layout table
        """<html><body><table width="100%"><tr><td colspan="2"><font size="5">Old Computer Pages</font></td></tr><tr><td class="menu"><a href="a.html">Machines</a><br><a href="b.html">Software</a><br><a href="c.html">Links</a></td>
<td class="content"><h1>The blue machine</h1><p>It was sold from 1983 to 1986 and had sixteen colours.</p><p>Its keyboard was the best of its time, which is why so many are still in use.</p><table><tr><th>Memory</th><td>48 KB</td></tr></table></td></tr></table><div class="footer">Last changed in 2003. <a href="mail">Contact</a></div></body></html>""",
        "The blue machine\nIt was sold from 1983 to 1986 and had sixteen colours.\nIts keyboard was the best of its time, which is why so many are still in use.\nMemory\n48 KB",
    ),
    (  # cookie notice, newsletter box and advertisement between paragraphs
        """<!doctype html><body class="single"><div class="cookie-consent"><p>We use cookies to make this site better. By using it you agree.</p><button>Accept</button></div><div class="site-header"><a href="/">The Stack</a></div>
<div class="post-content"><h1 class="title">Why caches lie</h1><p>A cache answers with what it knew, not with what is so.</p><div class="ad-slot">Advertisement: faster disks for less</div><p>That is fine until two of them disagree, and then someone is woken at night.</p>
<div class="newsletter"><h4>Get our letters</h4><form><input name=e><button>Subscribe</button></form></div><p>So give every entry an end.</p><pre>ttl = 60</pre></div><div class="share-buttons"><a>Tweet</a><a>Share</a></div><div class="related-posts"><h3>Related</h3><ul><li><a href=/x>Queues that never end</a></ul></div></body>""",
        "Why caches lie\nA cache answers with what it knew, not with what is so.\nThat is fine until two of them disagree, and then someone is woken at night.\nSo give every entry an end.\nttl = 60",
    ),
    (  # text right inside a container, parted by line breaks
        """<html><body><div id="header"><img src=l.png> Harbour Museum</div><ul id="navigation"><li><a href=1>Visit</a></li><li><a href=2>Shows</a></li><li><a href=3>Shop</a></li></ul><div id="main"><h2>The lamp room</h2>Forty lamps hang in the old oil store. The oldest was made in 1790 and burned whale oil.<br><br>The youngest has never been lit.</div><div id="sidebar"><h3>Opening hours</h3><p>Daily from ten to five</p></div><div id="foot">Harbour Museum, 1 Quay Street</div></body></html>""",
        "The lamp room\nForty lamps hang in the old oil store. The oldest was made in 1790 and burned whale oil. The youngest has never been lit.",
    ),
    (  # a main element with an aside and a figure
        """<body><a class="skip" href="#m">Skip to content</a><nav aria-label="Main"><a href="/">Home</a><a href="/b">Blog</a></nav><main id="m"><h1>Counting birds</h1><figure><img src=b.jpg><figcaption>A heron at dawn</figcaption></figure><p>We count them every January, before the ice breaks.</p><aside class="pull"><p>Sign up for the next count</p></aside><blockquote>Nobody told the geese.</blockquote><p>This year there were more herons than ever, and fewer ducks.</p></main><footer><p>Bird Club &middot; Imprint &middot; Privacy</p></footer></body>""",
        "Counting birds\nA heron at dawn\nWe count them every January, before the ice breaks.\nNobody told the geese.\nThis year there were more herons than ever, and fewer ducks.",
    ),
    (  # a forum answer page with a login form
        """<body><div class="topbar"><form class="login"><label>Username</label><input><label>Password</label><input><button>Log in</button></form></div><div class="breadcrumbs"><a href=/>Forum</a> &gt; <a href=/k>Kitchen</a></div><div class="article"><h1>How long does sourdough keep?</h1><div class="body"><p>Kept in a cloth it is good for five days.</p><p>Never put it in the fridge: it goes stale there in a day or two, since cold starch sets faster than warm starch does.</p></div></div><div class="responses"><div class="reply"><p>Mine kept for nine days, honestly.</p></div><div class="reply"><p>And in a box?</p></div></div><div class="footer-links"><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body>""",
        "How long does sourdough keep?\nKept in a cloth it is good for five days.\nNever put it in the fridge: it goes stale there in a day or two, since cold starch sets faster than warm starch does.",
    ),
    (  # sections, a table of contents, a formula and a quote left open
        """<body><div class="page"><div class="toc"><ul><li><a href=#a>1 Falling</a><li><a href=#b>2 Rising</a></ul></div><section class="text"><h2 id=a>1 Falling</h2><p>A stone falls by <math><mi>s</mi><mo>=</mo><mi>g</mi><msup><mi>t</mi><mn>2</mn></msup></math> over two.</p><h2 id=b>2 Rising</h2><p>What was thrown up comes <em>down</em> again in the time that it took to rise.</p></section><div class="pagination"><a href=1>Previous</a> <a href=2>Next</a></div></div><div class="copyright">Copyright 2011 by the authors</div></body>""",
        "1 Falling\nA stone falls by s=gt2 over two.\n2 Rising\nWhat was thrown up comes down again in the time that it took to rise.",
    ),
]
