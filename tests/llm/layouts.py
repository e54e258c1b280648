"""Pages written by hand, of layouts that the training pages don't have, each with its main text."""

from __future__ import annotations

import random

SENTENCES = """The river rose by two metres during the night and reached the lower streets of the town before dawn.
Residents were asked to move their cars to the square on the hill, where the school had opened its gym.
According to the council, no one was hurt, though several cellars will have to be pumped dry this week.
It was the third flood in ten years. Engineers had warned that the old wall would not hold for ever.
A new barrier is planned upstream; its cost is put at four million, half of which the region will pay.
"We have talked about it since I was a child," said one shop owner, sweeping mud from the doorstep.
Trains were running again by noon, with delays of up to forty minutes on the southern line.
The library lost about three hundred books, most of them from the children's shelves on the ground floor.
Volunteers filled sandbags until the evening, and a bakery sent bread and coffee to everyone who helped.
Whether the market can open on Saturday will be decided on Friday, after the paving has been checked.
In the long run, planners want to give the river more room by opening two meadows that were once diked.
The method needs three steps: measure the depth, mark the edge of the water, and compare it with the chart.""".split("\n")


class Writer:
    def __init__(self, seed: int):
        self.random, self.main = random.Random(seed), []

    def own(self, text: str) -> str:
        """A block of main text."""
        self.main.append(text)
        return text

    def say(self, n: int = 2) -> str:
        return self.own(" ".join(self.random.sample(SENTENCES, n)))

    def paragraphs(self, n: int) -> str:
        return "".join(f"<p>{self.say(self.random.randint(1, 4))}</p>\n" for _ in range(n))

    def links(self, n: int) -> str:
        names = self.random.sample(["Home", "News", "Sport", "Weather", "About us", "Contact", "Archive", "Jobs", "Shop", "Help centre", "Sign in", "Local", "World", "Opinion"], n)
        return "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(names))


def encyclopedia(w: Writer) -> str:
    return f"""<html><head><title>Flood</title></head><body class="skin-vector"><div id="mw-navigation"><ul>{w.links(6)}</ul></div>
<div id="content" class="mw-body"><h1 id="firstHeading">{w.own("Flood of the lower town")}</h1><div id="bodyContent"><div id="mw-content-text">
{w.paragraphs(2)}<h2><span class="mw-headline">{w.own("Course of events")}</span></h2>{w.paragraphs(3)}
<ul><li>{w.own("Water level at noon: 4.2 metres")}</li><li>{w.own("Water level at midnight: 5.9 metres")}</li></ul>{w.paragraphs(1)}</div></div></div>
<div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May.</li><li>Text is available under a free licence.</li></ul></div></body></html>"""


def tables(w: Writer) -> str:
    body = "<br><br>".join(w.own(" ".join(w.random.sample(SENTENCES, 3))) for _ in range(4))
    w.main[-4:] = [" ".join(w.main[-4:])]
    return f"""<html><body bgcolor=white><table width=100%><tr><td colspan=3><font size=5><a href=/>The Valley Herald</a></font></td></tr>
<tr><td width=15% valign=top><a href=1>Front page</a><br><a href=2>Sports</a><br><a href=3>Classifieds</a></td>
<td width=70%><h2>{w.own("River floods lower town again")}</h2>{body}</td>
<td width=15%><a href=ad1><b>Cheap tyres!</b></a><br><a href=ad2>Win a holiday</a></td></tr>
<tr><td colspan=3 align=center><small>Copyright &copy; 1999 The Valley Herald. All rights reserved.</small></td></tr></table></body></html>"""


def blog(w: Writer) -> str:
    return f"""<html><body><div id="wrap"><div id="header"><h1><a href="/">Notes from the bank</a></h1><p class="description">A weblog about rivers</p></div><ul id="nav">{w.links(4)}</ul>
<div id="main-col"><div class="post hentry"><h2 class="entry-title">{w.own("After the flood")}</h2><div class="entry">{w.paragraphs(4)}<blockquote><p>{w.say(1)}</p></blockquote>{w.paragraphs(1)}</div>
<div class="sharedaddy"><h3>Share this:</h3><ul><li><a href="#">Mail</a></li><li><a href="#">Print</a></li></ul></div></div>
<div id="comments"><h3>3 Responses to After the flood</h3><ol class="commentlist"><li class="comment"><cite>Ann</cite> says: <p>Thank you for writing this, we were away and worried all night.</p></li><li class="comment"><cite>Bo</cite> says: <p>I saw the same thing in our street.</p></li></ol>
<div id="respond"><h3>Leave a Reply</h3><form action="/post"><p>Your email address will not be published.</p><label>Name</label><input name=a><textarea name=c></textarea><button>Post Comment</button></form></div></div></div>
<div id="sidebar"><div class="widget"><h4>Recent posts</h4><ul><li><a href=a>On low water</a></li><li><a href=b>The old mill</a></li></ul></div></div><div id="footer"><p>Powered by a weblog program. Theme by nobody.</p></div></div></body></html>"""


def manual(w: Writer) -> str:
    return f"""<html><body><div class="related" role="navigation"><h3>Navigation</h3><ul><li><a href=i>index</a></li><li><a href=n>next</a> |</li><li><a href=p>previous</a> |</li></ul></div>
<div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="s"><h1>{w.own("Measuring water levels")}</h1>{w.paragraphs(2)}
<pre>{w.own("level --gauge 3 --since monday")}</pre><dl><dt>{w.own("--gauge")}</dt><dd><p>{w.say(1)}</p></dd><dt>{w.own("--since")}</dt><dd><p>{w.say(1)}</p></dd></dl><section><h2>{w.own("Limits")}</h2>{w.paragraphs(2)}</section></section></div></div></div>
<div class="sphinxsidebar" role="navigation"><h3><a href=x>Table of Contents</a></h3><ul>{w.links(3)}</ul><div id="searchbox"><form><input name=q><input type=submit value=Go></form></div></div></div>
<div class="footer" role="contentinfo">&copy; Copyright 2021, The authors. Created using a tool.</div></body></html>"""


def news(w: Writer) -> str:
    return f"""<html><body><div class="skip"><a href="#c">Skip to content</a></div><header class="masthead"><a href="/">Daily</a><nav><ul>{w.links(7)}</ul></nav></header><div class="cookie-banner"><p>We use cookies to make this site work better for you.</p><button>Accept all</button></div>
<main id="c"><div class="story-body"><h1>{w.own("Lower town under water")}</h1><p class="lede">{w.say(1)}</p>{w.paragraphs(2)}
<aside class="related"><h4>More on this story</h4><ul><li><a href=1>Barrier delayed again</a></li><li><a href=2>How floods happen</a></li></ul></aside>{w.paragraphs(3)}<div class="ad-slot"><span>Advertisement</span></div>{w.paragraphs(2)}</div>
<section class="comments"><h3>Comments (2)</h3><div class="comment"><b>reader7</b><p>This was foreseeable, and nobody did a thing about it for years.</p></div><div class="comment"><b>kim</b><p>Stay safe everyone!</p></div></section></main>
<footer><ul>{w.links(5)}</ul><p>&copy; 2023 Daily Media Ltd. Registered in the valley.</p></footer></body></html>"""


def plain(w: Writer) -> str:
    return f"<html><body><h1>{w.own('A night at the river')}</h1>{w.paragraphs(6)}<hr><p><small>&copy; 2004. <a href=/>Back to the index</a></small></p></body></html>"


def div_soup(w: Writer) -> str:
    body = "".join(f'<div class="x{i}b"><div class="q9"><span>{w.say(2)}</span></div></div>' for i in range(6))
    return f"""<html><body><div id="root"><div class="k1"><div class="k2"><a href=/>Valley</a><a href=/a>Stories</a><a href=/b>Pictures</a><a href=/c>Log in</a></div></div>
<div class="z3"><div class="z4"><div class="h77">{w.own("What the flood left behind")}</div>{body}</div></div>
<div class="m8"><div><a href=/p>Privacy</a></div><div><a href=/t>Terms</a></div><div>© Valley 2024</div></div></div></body></html>"""


def data_table(w: Writer) -> str:
    head, intro = w.own("Levels of the week"), w.own("This is how high the water stood.")
    rows = "".join(f"<tr><td>{w.own(a)}</td><td>{w.own(b)}</td></tr>" for a, b in (("Monday", "3.1 m"), ("Tuesday", "4.4 m"), ("Wednesday", "5.9 m")))
    return f"""<html><body><div class="topbar"><ul class="menu">{w.links(5)}</ul></div><div class="container"><div class="row"><div class="col-8 content-area"><h1>{head}</h1><p>{intro}</p><table class="table"><tbody>{rows}</tbody></table>{w.paragraphs(3)}</div>
<div class="col-4 sidebar"><div class="panel"><h3>Newsletter</h3><form><input><button>Subscribe</button></form></div><div class="panel"><h3>Popular</h3><ul>{w.links(4)}</ul></div></div></div></div><div class="site-footer">Imprint | Contact | © 2022</div></body></html>"""


def recipe(w: Writer) -> str:
    items = "".join(f"<li>{w.own(x)}</li>" for x in ("500 g flour", "two spoons of salt", "a litre of water"))
    return f"""<html><body><div role="banner"><a href=/>Kitchen</a></div><div role="navigation"><ul>{w.links(4)}</ul></div><div role="main"><h1>{w.own("Bread for volunteers")}</h1>{w.paragraphs(1)}<h3>{w.own("What you need")}</h3><ul>{items}</ul><h3>{w.own("What to do")}</h3><ol><li>{w.say(1)}</li><li>{w.say(2)}</li></ol>
<div class="share-buttons"><a href=#>Pin it</a> <a href=#>Mail it</a></div></div><div role="complementary"><h3>You may also like</h3><ul><li><a href=1>Soup for cold days</a></li></ul></div><div role="contentinfo"><p>© Kitchen. Terms of use.</p></div></body></html>"""


def docs_with_notice(w: Writer) -> str:
    return f"""<html><body><noscript><div>Please enable JavaScript to view this site.</div></noscript><div class="announcement">Our shop is closed until Monday.</div><div id="page"><div id="masthead"><p><a href=/>Rivers</a></p></div><div id="primary"><div id="text"><h1>{w.own("How the gauge works")}</h1>{w.paragraphs(5)}</div></div></div><div id="colophon"><p>Proudly made in the valley. <a href=/p>Privacy policy</a></p></div></body></html>"""


LAYOUTS = (encyclopedia, tables, blog, manual, news, plain, div_soup, data_table, recipe, docs_with_notice)


def pages(seed: int = 1, times: int = 5):
    """(name, html, main text)"""
    for layout in LAYOUTS:
        for i in range(times):
            w = Writer(seed * 1000 + i)
            html = layout(w)
            yield layout.__name__, html, " ".join(w.main)
