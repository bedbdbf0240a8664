"""What the names of an element (class, id, role) say it is for."""

from __future__ import annotations

import re
from functools import lru_cache

#: Name words by what they tell, the groups in the order in which they decide between words of one name.
NAME_GROUPS = {
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback",
    "ad": "ad ads advert adverts advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored commercial",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal overlay announcement warning disclaimer paywall",
    "share": "share sharing social follow",
    "form": "form login signup signin subscribe newsletter search contact register",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager tabs skip",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular teaser rail complementary",
    "foot": "footer bottom copyright colophon legal imprint contentinfo",
    "head": "header masthead topbar branding logo hero",
    "main": "content article post entry main body story text maincontent articlebody prose",
}
_GROUP_OF = {word: group for group, words in NAME_GROUPS.items() for word in words.split()}
_ORDER = list(NAME_GROUPS)
#: Beginnings of names that tell of something elsewhere on the page: has-sidebar, no-comments.
_ABOUT = frozenset("with has have no is open show hide without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")  # parts of siteFooter, site-footer, SITE_FOOTER


@lru_cache(maxsize=4096)
def group_of(word: str) -> str | None:
    """The group of a name word: listed, or a compound that begins or ends with a listed word of five letters or more."""
    if word in _GROUP_OF:
        return _GROUP_OF[word]
    inside = [w for w in _GROUP_OF if len(w) >= 5 and (word.startswith(w) or word.endswith(w))]
    return _GROUP_OF[max(inside, key=len)] if inside else None


@lru_cache(maxsize=4096)
def _group_of_name(name: str) -> str | None:
    words = [w.lower() for w in _WORD.findall(name)]
    if words and words[0] in _ABOUT:
        return None
    groups = [g for w in words if (g := group_of(w))]
    return min(groups, key=_ORDER.index) if groups else None


def group_of_names(values: list[str]) -> str | None:
    """The group that the names in some attribute values tell, None if they tell none."""
    groups = [g for value in values for name in value.split() if (g := _group_of_name(name))]
    return min(groups, key=_ORDER.index) if groups else None
