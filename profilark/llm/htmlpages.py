"""Labelled pages: flat text blocks as they stand on common kinds of sites, written by hand.

A page is a list of (where the block stands, words, linked words, is main text); a step of a place is a
tag with an optional class.  ``TRAINING`` grows the tree, ``HELD_OUT`` only measures it.
"""

from __future__ import annotations

Page = list[tuple[str, int, int, int]]

TRAINING: list[Page] = [
    # a news article
    [("header.site-header nav ul li", 1, 1, 0)] * 5 + [("div.breaking-news p", 9, 9, 0), ("main article header h1", 11, 0, 1), ("main article p", 34, 0, 1), ("main article p", 51, 2, 1), ("main article figure figcaption", 12, 0, 1), ("main article div.ad-slot", 6, 2, 0), ("main article p", 44, 0, 1), ("main article blockquote p", 27, 0, 1), ("main article p", 8, 0, 1), ("main article div.share-buttons ul li", 1, 1, 0), ("main article div.share-buttons ul li", 2, 2, 0), ("aside.sidebar h3", 2, 0, 0), ("aside.sidebar ul li", 8, 8, 0), ("aside.sidebar ul li", 7, 7, 0), ("footer p", 14, 5, 0)],
    # a blog
    [("div.header h1", 3, 3, 0), ("div.header p", 7, 0, 0), ("div.post h2", 6, 0, 1), ("div.post div.entry p", 68, 1, 1), ("div.post div.entry p", 25, 0, 1), ("div.post div.entry ul li", 9, 0, 1), ("div.post div.entry ul li", 4, 0, 1), ("div.post div.entry p", 40, 4, 1), ("div.post div.related-posts h3", 2, 0, 0), ("div.post div.related-posts ul li", 6, 6, 0), ("div.comments-area h3", 3, 0, 0), ("div.comments-area ol li p", 36, 0, 0), ("div.comments-area ol li p", 58, 1, 0), ("div.comments-area form p", 14, 0, 0), ("div.widget-area div.widget h3", 2, 0, 0), ("div.widget-area div.widget ul li", 2, 2, 0), ("div.footer p", 9, 3, 0)],
    # a medical leaflet: names that sound like furniture, but hold the text
    [("nav ol li", 2, 2, 0), ("nav ol li", 1, 1, 0), ("main h1", 3, 0, 1), ("main section.overview p", 42, 0, 1), ("main section.side-effects h2", 2, 0, 1), ("main section.side-effects p", 63, 1, 1), ("main section.side-effects ul li", 3, 0, 1), ("main section.side-effects ul li", 6, 0, 1), ("main section.notice-of-interactions p", 38, 0, 1), ("main section.alerts-and-warnings p", 47, 2, 1), ("footer div.legal p", 30, 4, 0), ("footer ul li", 2, 2, 0)],
    # a law firm's article
    [("header div.top-menu ul li", 2, 2, 0), ("header div.search form", 3, 0, 0), ("article h1", 8, 0, 1), ("article div.legal-advice p", 60, 0, 1), ("article div.legal-advice p", 31, 0, 1), ("article div.copyright-law h2", 4, 0, 1), ("article div.copyright-law p", 71, 3, 1), ("article div.disclaimer p", 33, 0, 0), ("div.legal ul li", 3, 3, 0), ("div.copyright", 7, 0, 0)],
    # documentation
    [("nav.sidebar ul li", 2, 2, 0)] * 4 + [("nav.breadcrumbs ol li", 1, 1, 0), ("main div.body section h1", 4, 0, 1), ("main div.body section p", 29, 2, 1), ("main div.body section pre", 18, 0, 1), ("main div.body section p", 12, 0, 1), ("main div.body section dl dt", 3, 0, 1), ("main div.body section dl dd p", 22, 0, 1), ("main div.body section table tr td", 1, 0, 1), ("main div.body section table tr td", 7, 1, 1), ("main div.body div.note p", 26, 0, 1), ("main div.prev-next", 6, 4, 0), ("footer", 15, 2, 0)],
    # an encyclopedia
    [("div.navigation ul li", 2, 2, 0), ("div.navigation ul li", 1, 1, 0), ("div.content h1", 2, 0, 1), ("div.content div.main-text p", 92, 14, 1), ("div.content div.main-text p", 75, 11, 1), ("div.content div.main-text h2", 1, 0, 1), ("div.content div.main-text p", 58, 9, 1), ("div.content div.main-text ul li", 8, 2, 1), ("div.content div.main-text table tr td", 2, 1, 1), ("div.content div.navbox ul li", 2, 2, 0), ("div.content div.navbox ul li", 3, 3, 0), ("div.footer ul li", 18, 1, 0)],
    # a forum
    [("div.topbar ul li", 1, 1, 0), ("div.page h1", 9, 0, 1), ("div.page div.post p", 65, 0, 1), ("div.page div.post p", 14, 0, 1), ("div.page div.replies p", 30, 0, 0), ("div.page div.replies p", 48, 2, 0), ("div.page div.pagination", 5, 5, 0), ("form p", 6, 0, 0), ("div.footer", 11, 3, 0)],
    # a shop
    [("header ul.menu li", 1, 1, 0), ("header ul.menu li", 2, 2, 0), ("div.cookie-banner p", 31, 2, 0), ("main h1", 5, 0, 1), ("main div.description p", 55, 0, 1), ("main div.description ul li", 6, 0, 1), ("main div.description ul li", 4, 0, 1), ("main div.recommended h3", 4, 0, 0), ("main div.recommended ul li", 5, 5, 0), ("main div.newsletter p", 17, 0, 0), ("div.promo p", 12, 3, 0), ("footer p", 24, 5, 0)],
    # a recipe
    [("nav ul li", 1, 1, 0), ("article h1", 4, 0, 1), ("article p", 46, 0, 1), ("article ul li", 4, 0, 1), ("article ul li", 3, 0, 1), ("article ul li", 5, 0, 1), ("article ol li", 24, 0, 1), ("article ol li", 17, 0, 1), ("article div.social ul li", 1, 1, 0), ("article aside p", 28, 1, 0), ("section.comments article.comment p", 19, 0, 0), ("footer p", 8, 2, 0)],
    # a government page
    [("div.skip", 4, 4, 0), ("div.alert p", 21, 1, 0), ("header p", 6, 0, 0), ("div.breadcrumb ol li", 2, 2, 0), ("main h1", 7, 0, 1), ("main p", 39, 1, 1), ("main h2", 4, 0, 1), ("main p", 57, 2, 1), ("main p", 3, 0, 1), ("main p", 10, 5, 1), ("main div.related ul li", 6, 6, 0), ("main div.related ul li", 4, 4, 0), ("main div.feedback form p", 8, 0, 0), ("footer ul li", 2, 2, 0), ("footer p", 18, 3, 0)],
    # old pages in tables, without names
    [("table tr td", 2, 2, 0), ("table tr td", 1, 1, 0), ("table tr td", 2, 2, 0), ("table tr td h1", 6, 0, 1), ("table tr td p", 73, 1, 1), ("table tr td p", 41, 0, 1), ("table tr td p", 28, 0, 1), ("table tr td p", 90, 3, 1), ("table tr td", 9, 6, 0), ("table tr td", 4, 4, 0)],
    [("center", 4, 4, 0), ("h1", 4, 0, 1), ("p", 60, 0, 1), ("p", 37, 0, 1), ("h2", 3, 0, 1), ("p", 52, 2, 1), ("ul li", 7, 1, 1), ("ul li", 11, 0, 1), ("p", 30, 0, 1), ("address", 6, 4, 0)],
    # plain pages
    [("p", 2, 0, 1)], [("p", 60, 0, 1)], [("div", 25, 0, 1)], [("h1", 4, 0, 1), ("p", 20, 0, 1)], [("h1", 2, 0, 1), ("p", 70, 0, 1), ("p", 1, 0, 1), ("p", 55, 0, 1), ("p", 21, 0, 1), ("p", 3, 0, 1)],
    # nothing but furniture
    [("nav p", 30, 0, 0)], [("div.ad p", 60, 0, 0)], [("footer p", 40, 1, 0), ("nav ul li", 3, 3, 0)], [("div.sidebar p", 50, 0, 0)], [("form p", 35, 0, 0), ("form label", 2, 0, 0)], [("aside p", 44, 0, 0)],
    # text beside the article is not of it, however long
    [("div", 3, 3, 0), ("article p", 2, 0, 1), ("nav p", 55, 0, 0), ("article div.comment p", 70, 0, 0)],
    [("article h1", 3, 0, 1), ("article p", 40, 0, 1), ("div p", 48, 0, 0), ("div", 20, 3, 0), ("p", 9, 0, 0)],
    [("article p", 25, 25, 1), ("article p", 50, 9, 1), ("article p", 1, 0, 1), ("p", 62, 0, 0), ("div ul li", 3, 1, 0)],
    [("main h1", 3, 0, 1), ("main p", 100, 2, 1), ("main p", 3, 0, 1), ("main p", 14, 0, 1), ("main table tr td", 1, 0, 1), ("div p", 70, 0, 0), ("div", 30, 5, 0)],
    [("header p", 22, 0, 0), ("header h1", 3, 1, 0), ("article ul li", 2, 2, 1), ("article ul li", 4, 4, 1), ("article h2", 3, 0, 1), ("article p", 100, 30, 1), ("article p", 20, 0, 1), ("footer p", 50, 0, 0)],
    # an article that names itself by class alone
    [("div.menu ul li", 2, 2, 0), ("div.menu ul li", 1, 1, 0), ("div.content h1", 8, 0, 1), ("div.content p", 90, 3, 1), ("div.content p", 3, 0, 1), ("div.content p", 12, 4, 1), ("div.content ul li", 6, 0, 1), ("div.content div.ads", 16, 1, 0), ("div.content div.author", 4, 1, 1), ("div.comments p", 40, 0, 0), ("div.comments p", 3, 0, 0), ("div.footer p", 10, 2, 0)],
    # notices inside an article
    [("div.banner p", 14, 0, 0), ("article p.notice", 18, 1, 0), ("article h1", 4, 0, 1), ("article p", 33, 0, 1), ("article form p", 12, 0, 0), ("article div.popup p", 15, 1, 0), ("article header h2", 5, 0, 1), ("article p", 9, 9, 1), ("article div.subscribe p", 16, 2, 0), ("article p", 120, 10, 1), ("article pre", 20, 0, 1), ("article p", 1, 0, 1)],
    # last paragraphs before lists of links
    [("nav ul li", 2, 2, 0), ("article h1", 6, 0, 1), ("article p", 48, 0, 1), ("article p", 57, 1, 1), ("ul li", 4, 4, 0), ("ul li", 5, 5, 0), ("footer p", 9, 1, 0)],
    [("main h1", 4, 0, 1), ("main p", 30, 1, 1), ("main p", 66, 0, 1), ("main ul li", 3, 3, 1), ("main ul li", 4, 4, 1), ("main p", 45, 0, 1), ("div.sidebar ul li", 3, 3, 0), ("footer p", 20, 9, 0)],
    [("article p", 72, 6, 1), ("article p", 41, 0, 1), ("div.share ul li", 1, 1, 0), ("section.comments p", 50, 0, 0), ("div", 12, 12, 0), ("p", 44, 2, 0)],
    # a city's page
    [("div.skip-link", 3, 3, 0), ("header form", 2, 0, 0), ("nav ul li", 2, 2, 0), ("main article h1", 4, 0, 1), ("main article p", 38, 0, 1), ("main article ul li", 8, 1, 1), ("main article p.alert", 11, 1, 0), ("main article p", 52, 1, 1), ("main aside ul li", 4, 4, 0), ("footer p", 21, 2, 0)],
    # an essay in a table
    [("table tr td", 1, 1, 0), ("table tr td", 2, 2, 0), ("table tr td p", 88, 0, 1), ("table tr td p", 61, 0, 1), ("table tr td p", 54, 1, 1), ("table tr td", 6, 5, 0)],
    [("nav ul li", 2, 2, 0), ("article nav ul li", 3, 3, 0), ("article p", 64, 1, 1), ("article aside ul li", 4, 4, 0), ("article p", 55, 0, 1), ("article p", 7, 7, 1), ("article p", 58, 2, 1)],
    # a page about widgets and search: names of the subject
    [("nav ul li", 1, 1, 0), ("main h1", 5, 0, 1), ("main div.widgets-explained p", 54, 1, 1), ("main div.search-engines p", 66, 2, 1), ("main div.search-engines p", 41, 0, 1), ("main div.social-history p", 80, 4, 1), ("main div.widget ul li", 3, 3, 0), ("main div.share", 3, 3, 0), ("footer p", 12, 1, 0)],
]

HELD_OUT: list[Page] = [
    # a magazine
    [("header nav ul li", 2, 2, 0), ("header nav ul li", 1, 1, 0), ("div.advertisement p", 10, 3, 0), ("main article h1", 9, 0, 1), ("main article p", 71, 2, 1), ("main article p", 36, 0, 1), ("main article div.promo-box p", 13, 4, 0), ("main article h2", 4, 0, 1), ("main article p", 64, 1, 1), ("main article p", 5, 0, 1), ("main article ul.share li", 1, 1, 0), ("section.related-articles ul li", 7, 7, 0), ("section.comments p", 22, 0, 0), ("footer p", 16, 4, 0)],
    # a patient's guide
    [("nav.navbar ul li", 2, 2, 0), ("article h1", 5, 0, 1), ("article section.side-notes p", 49, 0, 1), ("article section.related-conditions p", 57, 3, 1), ("article section.related-conditions ul li", 4, 0, 1), ("article div.alert-levels p", 36, 0, 1), ("aside p", 25, 1, 0), ("footer", 10, 2, 0)],
    # a tutorial
    [("div.sidebar ul li", 3, 3, 0), ("div.sidebar ul li", 2, 2, 0), ("div.main h1", 5, 0, 1), ("div.main p", 44, 1, 1), ("div.main pre", 25, 0, 1), ("div.main p", 19, 0, 1), ("div.main ol li", 13, 0, 1), ("div.main table tr td", 2, 0, 1), ("div.newsletter p", 20, 0, 0), ("div.footer ul li", 2, 2, 0)],
    # a personal page
    [("p", 3, 3, 0), ("h1", 3, 0, 1), ("p", 66, 1, 1), ("p", 45, 0, 1), ("p", 58, 0, 1), ("p", 4, 4, 0)],
    # a press release
    [("header div.logo", 2, 2, 0), ("div.breadcrumbs", 5, 4, 0), ("main h1", 12, 0, 1), ("main p", 55, 0, 1), ("main p", 48, 1, 1), ("main p", 60, 2, 1), ("main div.contact p", 14, 2, 1), ("main div.social", 4, 4, 0), ("div.cookie p", 22, 1, 0), ("footer div.legal", 20, 4, 0)],
    # a discussion
    [("div.nav ul li", 1, 1, 0), ("div.story h1", 7, 0, 1), ("div.story p", 82, 1, 1), ("div.story p", 33, 0, 1), ("div.comment-list div.comment p", 45, 0, 0), ("div.comment-list div.comment p", 12, 0, 0), ("div.comment-list form p", 9, 0, 0), ("div.footer p", 8, 2, 0)],
    # a museum's page
    [("header div.menu ul li", 2, 2, 0), ("div.search form", 1, 0, 0), ("main h1", 6, 0, 1), ("main p", 63, 2, 1), ("main div.opening-notice p", 30, 0, 1), ("main ul li", 5, 0, 1), ("main aside p", 40, 1, 0), ("main aside ul li", 3, 3, 0), ("main p", 35, 0, 1), ("footer ul li", 2, 2, 0), ("footer p", 15, 2, 0)],
    # a story in a table
    [("table tr td", 1, 1, 0), ("table tr td", 1, 1, 0), ("table tr td h2", 5, 0, 1), ("table tr td p", 95, 0, 1), ("table tr td p", 44, 0, 1), ("table tr td p", 70, 2, 1), ("table tr td", 3, 3, 0)],
    # a review with a list of links first
    [("nav p", 6, 6, 0), ("article h1", 7, 0, 1), ("article nav ul li", 2, 2, 0), ("article p", 52, 0, 1), ("article p", 61, 3, 1), ("article div.ad p", 9, 1, 0), ("article p", 18, 0, 1), ("div.related ul li", 6, 6, 0), ("footer p", 12, 3, 0)],
]
