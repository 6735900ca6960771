"""More pages written by hand: comments, notices and headings whose names say nothing."""

import re

from sparsefold.llm import html_extract

ONE = "The lighthouse was built on the outer rock in the summer of a dry year, and the stones were rowed across from the quarry on the mainland."
TWO = "Its lamp burned oil until the cable was laid, and the keepers kept a cow, two goats and a garden in the lee of the wall."
THREE = "Visitors may climb the stairs on Sundays. The last boat leaves at four, and there is no shelter on the landing if the weather turns."
NOTE = "My grandfather rowed the stones as a boy and told us about it every winter."

LAYOUTS = {
    "comments under a heading": ("<body><div class=k1><h1>The light</h1><p>ONE</p><p>TWO</p></div><div class=k2><h3>3 comments</h3><div><p>Anna says:</p><p>NOTE</p></div><div><p>Bert says:</p><p>I was there last year and the stairs are steep.</p></div></div></body>", "The light ONE TWO"),
    "comments inside the article": ("<body><div><h1>The light</h1><p>ONE</p><p>TWO</p><p>THREE</p><div><h3>2 Replies</h3><div>Anna wrote: NOTE</div><div>Carl wrote: Thank you for this.</div></div></div></body>", "The light ONE TWO THREE"),
    "comments with dates": ("<body><section><h1>The light</h1><p>ONE</p><p>THREE</p></section><section><h2>Comments</h2><ul><li><b>Anna</b> NOTE <a href=#>Reply</a></li><li><b>Dora</b> What a lovely place. <a href=#>Reply</a></li></ul></section></body>", "The light ONE THREE"),
    "comments and a form": ("<body><div class=a9><h1>The light</h1><p>TWO</p><p>ONE</p></div><div class=b7><h3>12 Responses</h3><div class=q><div>Emil, 3 March 2019</div><div>NOTE</div></div><h3>Leave a reply</h3><textarea></textarea><button>Send</button></div></body>", "The light TWO ONE"),
    "notice above": ("<body><div>We use cookies to make this site work better. <button>Accept</button></div><div><h1>The light</h1><p>ONE</p><p>TWO</p></div></body>", "The light ONE TWO"),
    "notice with a paragraph": ("<body><div class=x3><p>This site uses cookies. Read more about how we use them.</p><button>OK</button><button>No</button></div><div class=x4><h1>The light</h1><p>TWO</p><p>THREE</p></div></body>", "The light TWO THREE"),
    "notice below": ("<body><div><h1>The light</h1><p>ONE</p><p>THREE</p></div><div>By using this site you consent to our terms. <button>Fine</button></div></body>", "The light ONE THREE"),
    "sign up box": ("<body><div class=m1><h2>The light</h2><p>ONE</p><p>TWO</p><p>THREE</p></div><div class=m2>Subscribe to our newsletter and get a story each week. <input name=mail><button>Go</button></div></body>", "The light ONE TWO THREE"),
    "sign up inside": ("<body><div><h1>The light</h1><p>ONE</p><div>Sign up for our newsletter to read more like this. <input name=m><button>Go</button></div><p>TWO</p><p>THREE</p></div></body>", "The light ONE TWO THREE"),
    "boxed heading": ("<body><div class=w1><div class=z8><h2>The light</h2></div><div class=t4>ONE</div><div class=t4>TWO</div></div><div class=f1>&copy; 2020 The island</div></body>", "The light ONE TWO"),
    "boxed headings": ("<body><div class=r2><div class=z8><h1>The light</h1></div><div class=t4>ONE</div><div class=z8><h2>The keepers</h2></div><div class=t4>TWO</div><div class=z8><h2>Visits</h2></div><div class=t4>THREE</div></div></body>", "The light ONE The keepers TWO Visits THREE"),
    "boxed heading and a menu": ("<body><ul class=n1><li><a href=1>Home</a><li><a href=2>Boats</a><li><a href=3>Walks</a></ul><div class=g6><div class=h1x><h1>The light</h1></div><div class=pp>THREE</div><div class=pp>ONE</div></div></body>", "The light THREE ONE"),
    "hashed paragraphs": ("<body><div class=c88><a href=1>Start</a> <a href=2>Archive</a></div><div class=c89><div class=c90>ONE</div><div class=c90>TWO</div><div class=c90>THREE</div></div></body>", "ONE TWO THREE"),
    "words of comments in the text": ("<body><div><h1>The light</h1><p>ONE</p><p>My aunt says the reply came by the next boat.</p><p>TWO</p></div><div><a href=1>Older</a> <a href=2>Newer</a></div></body>", "The light ONE My aunt says the reply came by the next boat. TWO"),
    "words of notices in the text": ("<body><div class=e1><h1>The light</h1><p>TWO</p><p>The keepers baked cookies for the children who came across in summer.</p><p>THREE</p></div></body>", "The light TWO The keepers baked cookies for the children who came across in summer. THREE"),
    "comments as a list": ("<body><div class=d1><h1>The light</h1><p>ONE</p><p>TWO</p></div><ol class=d2><li><p>Anna says:</p><p>NOTE</p></li><li><p>Finn says:</p><p>The goats are gone now.</p></li></ol></body>", "The light ONE TWO"),
    "comment count as a paragraph": ("<body><div><h1>The light</h1><p>THREE</p><p>ONE</p></div><div><p>5 comments</p><div>Anna: NOTE</div><div>Gerd: We went in May.</div></div><div>Copyright 2018</div></body>", "The light THREE ONE"),
    "notice and comments": ("<body><div>We use cookies. <button>OK</button></div><div class=a><h1>The light</h1><p>ONE</p><p>TWO</p></div><div class=b><h3>1 comment</h3><div>Anna says: NOTE</div></div></body>", "The light ONE TWO"),
    "wrapped notice": ("<body><div><div><div>Your privacy matters. We and our partners store things on your device. <button>Agree</button></div></div></div><div class=v><h1>The light</h1><p>TWO</p><p>ONE</p><p>THREE</p></div></body>", "The light TWO ONE THREE"),
    "article with a list": ("<body><div class=s1><div class=s2><h1>The light</h1></div><div class=s3>ONE</div><ul><li>Boats on Sundays</li><li>No shelter</li></ul><div class=s3>THREE</div></div><div class=s9><a href=1>Terms</a> | <a href=2>Privacy</a></div></body>", "The light ONE Boats on Sundays No shelter THREE"),
}


def _fill(s):
    return s.replace("ONE", ONE).replace("TWO", TWO).replace("THREE", THREE).replace("NOTE", NOTE)


def test_pages_without_telling_names():
    model = html_extract.trained()
    got = {k: html_extract.extract([_fill(page)], model)[0] for k, (page, _) in LAYOUTS.items()}
    wrong = {k: re.sub(f"{ONE}|{TWO}|{THREE}", "..", v) for k, v in got.items() if v != _fill(LAYOUTS[k][1])}
    assert len(LAYOUTS) == 20 and len(wrong) <= 4, wrong
