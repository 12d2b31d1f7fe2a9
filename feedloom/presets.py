"""Selector lists, URL templates and parameter defaults, and the four named extraction modes."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------------------------
# Fixed values. These must equal the source system's for its pages to be read the same way.
# ---------------------------------------------------------------------------------------------

# containers
HASHTAG_A_CONTAINERS = (
    "article[data-testid='tweet']",
    "div[data-testid='cellInnerDiv']",
    "div.css-1dbjc4n.r-1iusvr4.r-16y2uox",
    "div[data-testid='tweet']",
    "div.css-1dbjc4n.r-1loqt21.r-18u37iz.r-1ny4l3l.r-1udh08x",
)
HASHTAG_B_CONTAINERS = (
    "article[data-testid='tweet']",
    "div[data-testid='cellInnerDiv']",
    "div[data-testid='tweet']",
)
USER_A_CONTAINERS = ("article[data-testid='tweet']",)
USER_B_CONTAINERS = (
    "article[data-testid='tweet']",
    "div[data-testid='tweet']",
    "div.tweet",
    "div.js-stream-tweet",
)

# text
A_LENIENT_TEXT = ("div[data-testid='tweetText']", "div.css-901oao", ".r-1qd0xha")
A_STRICT_TEXT = ("div[data-testid='tweetText']",)
B_PLAIN_TEXT = ("div[data-testid='tweetText']", "div.css-901oao")
B_VISIBLE_TEXT = ("div[data-testid='tweetText']", "div.tweet-text", "p.tweet-text")

# author
AUTHOR_BLOCK = ("div[data-testid='User-Name']",)
B_VISIBLE_USER = ("div[data-testid='User-Name'] span", "span.username", "a.user")

# time
TIME_ELEMENT = ("time",)
B_VISIBLE_TIME = ("time", "span.tweet-timestamp", "a.tweet-timestamp")

# sign-in page markers, looked for in the final URL
HASHTAG_BLOCKED_MARKERS = ("login",)
USER_BLOCKED_MARKERS = ("login",)

# ordered candidate URLs, {t} is the cleaned target, put in raw
HASHTAG_URLS_A = (
    "https://twitter.com/search?q=%23{t}&src=typed_query&f=top",
    "https://twitter.com/hashtag/{t}?src=hashtag_click",
    "https://x.com/search?q=%23{t}&src=typed_query&f=top",
    "https://x.com/hashtag/{t}?src=hashtag_click",
)
HASHTAG_URLS_B = (
    "https://twitter.com/search?q=%23{t}&src=typed_query&f=top",
    "https://x.com/search?q=%23{t}&src=typed_query&f=top",
    "https://twitter.com/hashtag/{t}?src=hashtag_click",
    "https://x.com/hashtag/{t}?src=hashtag_click",
)
USER_URLS_A = ("https://twitter.com/{t}",)
USER_URLS_B = (
    "https://twitter.com/{t}",
    "https://x.com/{t}",
    "https://twitter.com/search?q=from%3A{t}&src=typed_query&f=live",
)

# defaults
MAX_TWEETS = 30
MIN_TWEETS = 10
MAX_SCROLLS_A = 10
MAX_SCROLLS_B = 5
UNKNOWN_USER = "Unknown"
TIME_ATTRIBUTE = "datetime"

# file names
FILE_SUFFIX = {"a": "_tweets.csv", "b": "_tweets_pw.csv"}
SIGIL = {"hashtag": "#", "user": "@"}

# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CardSpec:
    """Which elements are cards, where their fields are, and how a mode picks among the matches.

    ``rendering`` is how an element's text is written: ``lines`` (engine A) trims every line and puts
    blocks on lines of their own; ``inner_text`` (engine B) sets paragraphs apart by a blank line.
    """

    mode: str
    containers: tuple[str, ...]
    text: tuple[str, ...]
    user: tuple[str, ...]
    time: tuple[str, ...]
    time_attr: str = TIME_ATTRIBUTE
    rendering: str = "lines"

    def with_selectors(self, **lists: tuple[str, ...] | str) -> CardSpec:
        """The same mode over other markup."""
        return replace(self, **lists)


HASHTAG_A = CardSpec("A_lenient", HASHTAG_A_CONTAINERS, A_LENIENT_TEXT, AUTHOR_BLOCK, TIME_ELEMENT)
USER_A = CardSpec("A_strict", USER_A_CONTAINERS, A_STRICT_TEXT, AUTHOR_BLOCK, TIME_ELEMENT)
HASHTAG_B = CardSpec(
    "B_plain", HASHTAG_B_CONTAINERS, B_PLAIN_TEXT, AUTHOR_BLOCK, TIME_ELEMENT, rendering="inner_text"
)
USER_B = CardSpec(
    "B_visible", USER_B_CONTAINERS, B_VISIBLE_TEXT, B_VISIBLE_USER, B_VISIBLE_TIME, rendering="inner_text"
)
