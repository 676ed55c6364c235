"""Labelled pages from which the extractor's weights are learnt.

Main text stands between ⁅ and ⁆; the rest of a page is not main text.
"""

OPEN, CLOSE = "⁅", "⁆"

_WORDS = "the river rose over the old stone bridge while people watched from the hill and nobody spoke."
_MORE = "Later that week the council met again, heard both reports and agreed to repair the road."
_SHORT = "So it was."
_MID = "Nobody had asked them before."

PAGES = [
    f"""<html><head><title>Site - River</title><style>a{{}}</style></head><body>
    <header><a href="/">Daily Paper</a><p>News since 1900</p></header>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav>
    <article>{OPEN}<h1>River rises</h1><p>{_WORDS}</p><p>{_SHORT}</p><p>{_MORE} <a href="/x">Read the
    report</a> here.</p><ul><li>first point</li><li>second point</li></ul><p>Yes.</p>{CLOSE}</article>
    <aside><h3>Most read</h3><ul><li><a href="/1">Ten places to see</a></li></ul></aside>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I was there and saw it.</p></div></section>
    <footer><p>Copyright Daily Paper. All rights reserved.</p></footer></body></html>""",
    f"""<html><head><title>Blog</title></head><body><div id="top"><a href="/">My blog</a></div>
    <div class="menu"><a href="/1">About</a> <a href="/2">Archive</a> <a href="/3">Contact us</a></div>
    <div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div>
    <div class="post"><div class="entry">{OPEN}<h2>On bridges</h2><p>{_MORE}</p><p>{_WORDS}</p>
    <blockquote>{_SHORT}</blockquote><p>{_WORDS} <b>{_MORE}</b></p><h3>After</h3><p>No.</p>{CLOSE}</div></div>
    <div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div>
    <div class="sidebar"><p>Subscribe to the letter and never miss a post again.</p></div>
    <form><label>Your mail</label><input><button>Send</button></form>
    <div id="footer">Powered by a small engine</div></body></html>""",
    f"""<body><nav><a href="/">Start</a><a href="/shop">Shop</a></nav><div class="ad">Buy two pairs of shoes
    and pay for one only this week.</div><main>{OPEN}<h1>Walk</h1><p>{_WORDS}</p><p>{_MORE}</p>{CLOSE}
    <div class="ad">Best price for a holiday by the sea.</div>{OPEN}<p>{_MORE}</p><table><tr><td>one</td>
    <td>two words</td></tr></table><p>{_SHORT}</p>{CLOSE}</main><footer>Imprint <a href="/p">Privacy</a></footer>""",
    f"""<body><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><table><tr><td>
    <a href="/1">Archive</a><br><a href="/2">Links</a></td><td>{OPEN}<p>{_MORE}<br>{_SHORT}</p>
    <p>{_WORDS}</p><p>Good.</p><div>{_WORDS} {_MORE}</div>{CLOSE}</td></tr></table>
    <p><a href="/i">Imprint</a> <a href="/h">Help</a></p></body>""",
    f"""<body><header><h1><a href="/">The Weekly</a></h1><div>For readers everywhere</div></header><div id="wrap">
    <article><header>{OPEN}<h1>{_MID}</h1></header><p>{_MID}</p><section><h2>{_SHORT}</h2><p>{_MORE}</p>
    <p>{_MID} {_SHORT}</p><ol><li>{_MID}</li><li>{_WORDS}</li></ol></section><figure><img src="i.png"><figcaption>
    {_MID}</figcaption></figure><p>{_MID}</p><dl><dt>bridge</dt><dd>{_MID}</dd></dl><pre>{_MID}</pre>{CLOSE}
    <footer>Filed under roads</footer></article><div><h3>More</h3><ul><li><a href="/5">Five old mills worth a
    visit</a></li><li><a href="/6">Why the harvest was late this year</a></li></ul></div></div>
    <footer><ul><li><a href="/t">Terms</a></li></ul><p>Made with care</p></footer></body>""",
    f"""<html><head><title>notes</title></head><body>{OPEN}{_MID}<br>{_MORE}<br><br>{_MID}<br>{_WORDS}
    {_SHORT}{CLOSE}<hr><a href="/">back</a></body></html>""",
    f"""<body><ul><li><a href="/">Home</a></li><li><a href="/all">All stories</a></li></ul><div><div>
    {OPEN}<div>{_MORE}</div><div>{_MID}</div><div><span>{_WORDS}</span></div><div>{_SHORT}</div>
    <div>{_MID}</div>{CLOSE}</div></div><div><a href="/p">Privacy</a> <a href="/c">Contact</a></div></body>""",
]
