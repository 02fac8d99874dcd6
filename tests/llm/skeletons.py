"""Page skeletons that no training copy has: a page's article put into other markup, with surroundings of its own.

Each is a list of pieces; ``{main}`` stands for the article's markup, and in
``AROUND`` marks the texts of pieces that are no main text.
"""

AROUND = "Zzz "

_NAV = "<ul><li><a href=/a>Zzz start</a></li><li><a href=/b>Zzz about us</a></li><li><a href=/c>Zzz contact</a></li></ul>"
_COMMENTS = "<div class=c><p>Zzz what a fine read, thank you so much for it.</p></div><div class=c><p>Zzz I do not agree, see above.</p></div>"
_FOOT = "<p>Zzz copyright of the makers, all rights reserved.</p>"

SKELETONS = {
    "section article": f"<body><header>{_NAV}</header><section><article><section>{{main}}</section></article></section><footer>{_FOOT}</footer></body>",
    "primary": f"<body><div id=masthead>{_NAV}</div><div id=primary><div class=entry-content>{{main}}</div><div id=disqus_thread>{_COMMENTS}</div></div><div id=colophon>{_FOOT}</div></body>",
    "grid": f"<body><div id=page><div class=container><div class=row><div class=col-3><nav>{_NAV}</nav></div><div class=col-9><div class=content>{{main}}</div></div></div></div></div></body>",
    "deep grid": f"<body><div id=page><div class=container><div class=row><div class=col><div class=content>{{main}}</div></div></div><div class=row><footer>{_FOOT}</footer></div></div></div></body>",
    "main role": f"<body><div class=top-bar role=navigation>{_NAV}</div><div id=wrap><div role=main>{{main}}</div><aside>{_FOOT}</aside></div></body>",
    "post parts": f"<body><nav>{_NAV}</nav><div class=blog><div class=post><div class=post-inner>{{main}}</div><section id=comments>{_COMMENTS}</section></div></div></body>",
    "body class": f"<body class='post single'><div class=nav-bar>{_NAV}</div>{{main}}<footer class=x>{_FOOT}</footer></body>",
    "table layout": f"<body><table><tr><td class=sidebar>{_NAV}</td><td class=main>{{main}}</td></tr></table><div class=footer>{_FOOT}</div></body>",
    "app": f"<body><div id=root><div class=layout><div class=header>{_NAV}</div><main class=zq><div class=kd><div class=story-body>{{main}}</div></div></main></div></div></body>",
    "article wrapped": f"<body><div id=outer><div id=inner><div class=menu>{_NAV}</div><article class=hentry><div class=wrap>{{main}}</div><div class=share><p>Zzz share this with friends.</p></div></article></div></div></body>",
    "news": f"<body><div class=shell><div class=ads><p>Zzz buy two, pay one, only today.</p></div><section class=news><div class=article-text>{{main}}</div></section><div class=related>{_NAV}</div></div></body>",
    "docs": f"<body><div class=docs><aside class=toc>{_NAV}</aside><div class=docs-body><div class=markdown><section class=text>{{main}}</section></div></div></div></body>",
    "comments below": f"<body><header class=site-header>{_NAV}</header><div class=site><div class=entry><div class=body>{{main}}</div></div><ol class=comment-list><li>Zzz first of all, well done.</li><li>Zzz could not follow it.</li></ol></div></body>",
    "notice": f"<body><div class=cookie-notice><p>Zzz this site keeps cookies to serve you.</p></div><div class=w1><div class=w2><article>{{main}}</article></div></div><form><p>Zzz subscribe by mail.</p></form></body>",
}
