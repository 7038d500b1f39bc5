"""Pages written by hand, in layouts that the operator's own training pages do not have: (html, main text)."""

PAGES = [
    (
        """<!doctype html><html><head><title>Harbour</title></head><body class="home blog"><div id="wrap"><div id="masthead"><a href="/">The Daily Quay</a></div>
<div id="topnav"><a href="/news">News</a> | <a href="/sport">Sport</a> | <a href="/tv">TV</a></div>
<div class="story"><h1>Harbour to close for two weeks</h1><p>The harbour will close on Monday, the council said. Ships will be sent north.</p>
<p>Traders fear losses.</p><blockquote>We were not asked, said one of them.</blockquote><p>Work ends in <b>June</b>, if the weather holds.</p></div>
<div class="commentlist"><h3>3 Comments</h3><div class="comment odd"><p>Anna says:</p><p>Great news for the gulls. I like it.</p></div><div class="comment odd"><p>Ben says:</p><p>Again a closure, nobody listens to us.</p></div></div>
<div id="footer">&copy; 2020 The Daily Quay. All rights reserved.</div></div></body></html>""",
        ["Harbour to close for two weeks", "The harbour will close on Monday, the council said. Ships will be sent north.", "Traders fear losses.", "We were not asked, said one of them.", "Work ends in June, if the weather holds."],
    ),
    (
        """<html><body><header><img src=x><nav><ul><li><a href=/a>Start</a><li><a href=/b>About us</a></ul></nav></header>
<main><article><h1>How bees find home</h1><p>Bees look at the sun. They keep its angle in mind as they fly.</p><h2>Discussion</h2><p>It is not known how they do it on grey days, yet most arrive.</p>
<ul><li>Light that is polarised may help.</li><li>So may smell.</li></ul><p>The field has <math><mi>n</mi>=<mn>12</mn></math> hives.</p></article>
<section id="disqus_thread"><h2>Join the discussion</h2><article class="post"><header>Tom</header><p>Great post, thanks for it.</p></article><article class="post"><header>Ida</header><p>My bees never came back last year.</p></article></section></main>
<aside><h3>Read also</h3><p><a href=/c>Ten facts about ants</a></p></aside><footer><p>Contact | Imprint</p></footer></body></html>""",
        ["How bees find home", "Bees look at the sun. They keep its angle in mind as they fly.", "Discussion", "It is not known how they do it on grey days, yet most arrive.", "Light that is polarised may help.", "So may smell.", "The field has n=12 hives."],
    ),
    (
        """<html><body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept all</button></div>
<table><tr><td class="leftmenu"><a href=1>Index</a><br><a href=2>Letters</a><br><a href=3>Shop</a></td><td class="maincol"><article><h2>Letter from the north</h2>
<p>Snow fell for nine days. We burned the last of the wood on Sunday.</p><p>On the tenth day a sledge came.</p></article></td></tr></table>
<form action=/s><label>Search</label><input name=q><button>Go</button></form><div class="ad-box"><p>Buy two coats and pay for one!</p></div></body></html>""",
        ["Letter from the north", "Snow fell for nine days. We burned the last of the wood on Sunday.", "On the tenth day a sledge came."],
    ),
    (
        """<html><body><nav><a href=/>Home</a> <a href=/r>Recipes</a></nav><article class="recipe"><h1>Bread in an hour</h1><p>Mix flour, water and salt. Let it stand.</p>
<ol><li>Heat the oven well.</li><li>Bake for forty minutes.</li></ol><figure><img><figcaption>The loaf, cut open.</figcaption></figure><noscript>The video shows each step.</noscript>
<p>Eat it warm.</p><div class="respond"><h3>Leave a reply</h3><form><label>Name</label><input><textarea>Your words</textarea><button>Send</button></form></div></article>
<div class="newsletter">Get a recipe by mail each week!</div><footer><p>Made with love by the bakers.</p></footer></body></html>""",
        ["Bread in an hour", "Mix flour, water and salt. Let it stand.", "Heat the oven well.", "Bake for forty minutes.", "The loaf, cut open.", "The video shows each step.", "Eat it warm."],
    ),
    (
        """<html><body><div role="navigation" class="navbar"><ul><li><a href=1>Docs</a></li><li><a href=2>Blog</a></li></ul></div><div class="post-content"><h1>Release notes</h1>
<p>This version starts faster and needs less memory.</p><pre>run --fast</pre><h3>Known faults</h3><p>Windows may flicker. We work on it.</p></div>
<ul class="responses"><li class="msg"><p>2 hours ago</p><p>Does it run on my old laptop?</p></li><li class="msg"><p>5 hours ago</p><p>Thank you, it is much faster.</p></li><li class="msg"><p>6 hours ago</p><p>Mine flickers.</p></li></ul>
<div class="sidebar"><h4>Tags</h4><p><a href=t>speed</a></p></div><footer>&copy; blog.example</footer></body></html>""",
        ["Release notes", "This version starts faster and needs less memory.", "run --fast", "Known faults", "Windows may flicker. We work on it."],
    ),
    (
        """<html><body><article><header class="entry-header"><h1>Der Fluss</h1></header><section class="part"><p>Der Fluss war breit und grau.</p><p>Am Ufer standen Weiden.</p></section><section class="part"><p>Niemand kam mehr herüber.</p></section>
<section class="part"><p>So blieb es bis zum Frühling.</p></section></article><div id="kommentare"><h3>Kommentare</h3><div class="k"><p>Sehr schön geschrieben.</p></div><div class="k"><p>Ich kenne diesen Fluss gut.</p></div></div>
<footer>Impressum</footer></body></html>""",
        ["Der Fluss", "Der Fluss war breit und grau.", "Am Ufer standen Weiden.", "Niemand kam mehr herüber.", "So blieb es bis zum Frühling."],
    ),
]
