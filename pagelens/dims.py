"""Fixed values the results depend on.

Everything in this module is a FIXED VALUE: the word lists, signature patterns, domain lists and
header names must equal the analyzer we match, entry for entry, or results differ. They are kept
here as plain text, in their natural order, and turned into Spark columns by the operators.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must match the analyzer being reproduced)
# ---------------------------------------------------------------------------------------------

STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "arent", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "cannot", "could", "couldnt", "did", "didnt", "do", "does", "doesnt",
    "doing", "dont", "down", "during", "each", "few", "for", "from", "further", "had", "hadnt",
    "has", "hasnt", "have", "havent", "having", "he", "hed", "hell", "hes", "her", "here", "heres",
    "hers", "herself", "him", "himself", "his", "how", "hows", "i", "id", "ill", "im", "ive", "if",
    "in", "into", "is", "isnt", "it", "its", "itself", "just", "lets", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "ought",
    "our", "ours", "ourselves", "out", "over", "own", "same", "she", "shed", "shell", "shes",
    "should", "shouldnt", "so", "some", "such", "than", "that", "thats", "the", "their", "theirs",
    "them", "themselves", "then", "there", "theres", "these", "they", "theyd", "theyll", "theyre",
    "theyve", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was",
    "wasnt", "we", "wed", "well", "were", "werent", "weve", "what", "whats", "when", "whens",
    "where", "wheres", "which", "while", "who", "whos", "whom", "why", "whys", "with", "wont",
    "would", "wouldnt", "you", "youd", "youll", "youre", "youve", "your", "yours", "yourself",
    "yourselves", "www", "com", "http", "https", "html",
]

# HTML elements without content
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

# Fixed values of HTML: elements whose body is raw text, whose body is text without tags, and whose text is not shown.
RAW_TEXT_ELEMENTS = ("script", "style", "xmp", "iframe", "noembed", "noframes")
TEXT_ONLY_ELEMENTS = ("textarea",)
HIDDEN_ELEMENTS = ("noscript", "template")

# Fixed values of HTML: implied end tags. A start tag of the first group ends the outermost open element of the second that
# is not outside one of the third.
_BLOCKS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
           "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
_CELLS = ("td", "th", "caption", "table", "template")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IMPLIED_ENDS = (
    (_HEADINGS, ("p",) + _HEADINGS, _CELLS + tuple(b for b in _BLOCKS if b not in ("p", "hr")) + ("button", "object", "li", "dd", "dt")),
    (_BLOCKS, ("p",), _CELLS + ("button", "object", "li", "dd", "dt")),
    (("li",), ("li", "p"), _CELLS + ("ul", "ol", "menu")),
    (("dd", "dt"), ("dd", "dt", "p"), _CELLS + ("dl",)),
    (("option",), ("option",), ("select", "optgroup", "datalist")),
    (("optgroup",), ("option", "optgroup"), ("select",)),
    (("td", "th"), ("td", "th"), ("tr", "table", "template")),
    (("tr",), ("td", "th", "tr", "caption", "colgroup"), ("tbody", "thead", "tfoot", "table", "template")),
    (("tbody", "thead", "tfoot"), ("td", "th", "tr", "caption", "colgroup", "tbody", "thead", "tfoot"), ("table", "template")),
    (("a",), ("a",), _CELLS + ("button", "object")),
    (("title",), ("title",), ()),
    (("body",), ("head",), ()),
)

# technology name -> patterns (searched case-insensitively over html + " " + "k:v k:v ...")
TECH_SIGNATURES = [
    ("WordPress", [r"wp-content", r"wp-includes", r"/wp-json/"]),
    ("Shopify", [r"cdn\.shopify\.com", r"Shopify\.theme"]),
    ("Wix", [r"static\.wixstatic\.com", r"\bwix\.com\b"]),
    ("Squarespace", [r"squarespace\.com", r"static1\.squarespace\.com"]),
    ("Drupal", [r"Drupal\.settings", r"/sites/default/files"]),
    ("Joomla", [r"/media/jui/", r"Joomla!"]),
    ("React", [r"react(-dom)?(\.min)?\.js", r"data-reactroot", r"__REACT"]),
    ("Vue.js", [r"vue(\.min)?\.js", r"__vue__", r"data-v-"]),
    ("Angular", [r"ng-app", r"angular(\.min)?\.js", r"ng-version"]),
    ("jQuery", [r"jquery[.\-]?(\d[\w.]*)?(\.min)?\.js"]),
    ("Bootstrap", [r"bootstrap(\.min)?\.css", r"bootstrap(\.min)?\.js"]),
    ("Google Analytics", [r"google-analytics\.com", r"gtag\(", r"\bga\(\s*['\"]"]),
    ("Google Tag Manager", [r"googletagmanager\.com"]),
    ("Cloudflare", [r"cloudflare"]),
    ("Font Awesome", [r"font-?awesome"]),
    ("Next.js", [r"__NEXT_DATA__", r"_next/static"]),
    ("PHP", [r"\.php(\?|\"|'|$)"]),
]

# netloc substring -> platform, in the order they are tried
SOCIAL_DOMAINS = [
    ("facebook.com", "Facebook"), ("fb.com", "Facebook"),
    ("twitter.com", "Twitter/X"), ("x.com", "Twitter/X"),
    ("instagram.com", "Instagram"), ("linkedin.com", "LinkedIn"),
    ("youtube.com", "YouTube"), ("youtu.be", "YouTube"),
    ("tiktok.com", "TikTok"), ("pinterest.com", "Pinterest"),
    ("github.com", "GitHub"), ("reddit.com", "Reddit"),
    ("t.me", "Telegram"), ("wa.me", "WhatsApp"),
    ("discord.gg", "Discord"), ("discord.com", "Discord"),
]

EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"\+?\d{1,3}?[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"

SECURITY_HEADER_NAMES = [
    "Strict-Transport-Security", "Content-Security-Policy", "X-Frame-Options",
    "X-Content-Type-Options", "X-XSS-Protection", "Referrer-Policy", "Permissions-Policy",
]

# iframe src substrings that mark an embedded player
PLAYER_MARKERS = ["youtube.com", "youtu.be", "vimeo.com", "player.vimeo"]

# email endings that are file names, not addresses
NON_EMAIL_SUFFIX = r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$"

# words of a page: ASCII letters and apostrophe
WORD_PATTERN = r"[A-Za-z']+"

WORDS_PER_MINUTE = 200
TEXT_SAMPLE_CHARS = 300
LINK_TEXT_CHARS = 80
TOP_KEYWORDS = 15

# default user agent of the crawler; robots matching uses only the lower-cased text before the
# first "/", i.e. "mozilla"
DEFAULT_USER_AGENT = "Mozilla/5.0 (X11; Linux x86_64) pagelens/0.1"

# layout of the text report (fixed values): widths of a section line, of a sub-section line and of a key
SECTION_WIDTH, SUBSECTION_WIDTH, KEY_WIDTH = 74, 44, 24

# URL schemes that resolve relative references / carry a network location (Python's urllib lists)
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                 "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
               "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp",
               "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]

# ---------------------------------------------------------------------------------------------


def stopword_list() -> list[str]:
    return list(STOPWORDS)


def social_platforms() -> list[tuple[str, list[str]]]:
    """Platforms in first-seen order with the domains that map to each."""
    out: dict[str, list[str]] = {}
    for dom, name in SOCIAL_DOMAINS:
        out.setdefault(name, []).append(dom)
    return list(out.items())
