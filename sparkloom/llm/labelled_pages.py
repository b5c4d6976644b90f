"""Small labelled pages from which the extraction weights are learnt: the main text stands between
the comments main and /main. They are a fixed, bounded set of invented pages in common layouts."""

_NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">Contact</a></li></ul></nav>'
_FOOT = '<footer><p>Copyright of the owner, all rights reserved.</p><a href="/t">Terms</a> <a href="/p">Privacy</a></footer>'
_TEXT = "The river rose again in the night and by morning the lower road was closed to all but the heaviest carts."
_MORE = "Those who had stayed behind carried what they could to the mill, where the floors were dry and a fire was kept."

LABELLED_PAGES = [
    f"<html><head><title>A flood</title></head><body>{_NAV}<div class='ad'>Buy two lamps and get one free</div><!--main--><article><h1>A flood</h1><p>{_TEXT}</p><p>{_MORE} <b>Nobody</b> was hurt.</p></article><!--/main-->{_FOOT}</body></html>",
    f"<html><body><header><a href='/'>The Valley Paper</a><p>News since long ago</p></header>{_NAV}<main><!--main--><h1>Floods in the valley</h1><h2>The lower road</h2><p>{_TEXT}</p><ul><li>Bread and lamp oil</li><li>Dry blankets</li></ul><p>{_MORE}</p><!--/main--></main><aside><h3>Most read</h3><ul><li><a href='/1'>Ten lamps compared for you</a></li><li><a href='/2'>The best mills to see</a></li></ul></aside>{_FOOT}</body></html>",
    f"<html><body><div id='top'><a href='/'>Start</a> | <a href='/x'>Archive</a> | <a href='/y'>Sign in</a></div><div class='content'><!--main--><h1>Notes on a flood</h1><div>{_TEXT}</div><div>{_MORE}</div><blockquote>{_TEXT}</blockquote><!--/main--></div><div class='comments'><h3>Comments</h3><div><p>Great story, thanks for this.</p></div><div><p>I was there and it was worse.</p></div></div><div class='footer'><a href='/z'>Imprint</a></div></body></html>",
    f"<html><body><table><tr><td><a href='/1'>One</a><br><a href='/2'>Two</a><br><a href='/3'>Three</a></td><td><!--main--><h2>The mill</h2><p>{_MORE}<p>{_TEXT}<p>{_MORE}<!--/main--></td></tr></table><form><input name='q'><button>Search</button></form></body></html>",
    f"<html><body><div class='cookie-notice'><p>We use cookies to make this page work.</p><button>Accept</button></div>{_NAV}<!--main--><article><p>{_TEXT}</p><div class='promo'><a href='/s'>Subscribe now and save</a></div><p>{_MORE}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>2 m</td></tr></table></article><!--/main--><section class='related'><h3>See also</h3><a href='/r'>Another flood of that year</a></section>{_FOOT}</body></html>",
]
