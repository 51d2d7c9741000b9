"""Fixed values of rendering: removal rules, roots, block handlers, markup tokens."""

RULES = {
    "generic": {
        "tags": ["script", "style", "link", "img", "figure", "audio", "video", "map", "meta",
                 "nav", "header", "footer", "form", "iframe", "svg"],
        "classes": ["navbox", "sidebar", "infobox", "noprint", "gallery", "mw-editsection",
                    "hatnote", "toc"],
        "ids": [],
        # (kind, value) in priority order; the document itself is the last resort
        "roots": [("class", "mw-parser-output"), ("tag", "main"), ("tag", "article"), ("tag", "body")],
    },
    "wikipedia": {
        "tags": ["script", "style", "link", "img", "figure", "audio", "video", "map", "meta"],
        "classes": ["navbox", "navbox-styles", "navbox-inner", "vertical-navbox", "nomobile",
                    "sidebar", "infobox", "hatnote", "navigation-not-searchable", "metadata",
                    "mw-editsection", "noprint", "mw-jump-link", "gallery", "thumb", "thumbinner",
                    "mw-empty-elt", "ambox", "mbox-small", "authority-control", "toc",
                    "shortdescription", "printfooter", "catlinks", "noviewer"],
        "ids": [],
        "roots": [("class", "mw-parser-output"), ("tag", "body")],
    },
    "gutenberg": {
        "tags": ["script", "style", "link", "img", "header", "footer", "nav", "form", "input",
                 "svg", "button", "noscript"],
        "classes": ["l10nselector", "spinner", "pg-boilerplate", "navbar"],
        # only the first element with each id is removed
        "ids": ["pg-header", "pg-machine-header", "pg-footer", "pg-start-separator",
                "pg-end-separator", "spinner"],
        "roots": [("class", "document"), ("id", "content"), ("tag", "body")],
    },
}
RENDERERS = list(RULES)
BY_TYPE = "by_type"      # the rule set that the column ``renderer`` names
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_TYPES = {**{h: "heading" for h in HEADINGS}, "p": "p", "ul": "list", "ol": "list",
               "dl": "dl", "blockquote": "quote", "pre": "pre", "table": "table"}
BLOCK_SKIP = ["script", "style", "link"]
WIKI_BLOCK_SKIP = ["sup", "sub"]
INLINE_TYPES = ("p", "quote", "list", "dl", "references")
TEXTLIKE = ["text", "comment", "doctype", "pi"]
BOLD = ["b", "strong"]
ITALIC = ["i", "em", "var", "dfn"]
CODE = ["code", "kbd", "samp", "tt"]
EXTERNAL_PREFIXES = ["http://", "https://", "//", "mailto:", "tel:"]
EXTERNAL_CLASSES = ["external", "extiw"]
LINK_COLOR, CITE_COLOR, NAV_COLOR = "33f", "5bf", "0af"
CODE_BG, CODE_FG = "100", "9d9"
TOP_ANCHOR = "`:top"
TABLE_FENCE = "`t"
CONTENTS_RULE = "-─"
BACK_TO_TOP = f"\n\n`c`F{NAV_COLOR}`_`[↑ Back to top`#top]`_`f`a\n"
DEFAULT_PAGE_ROOT = "/page"
