"""The page scanner against one regular expression, and in linear time on malformed pages."""

import os
import random
import re
import sys
import time

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from plumbline.llm import html_text  # noqa: E402

#: The same tokens as one pattern, which rescans the page from every unclosed tag.
PATTERN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)


def test_tokens_equal_the_pattern():
    rng = random.Random(12)
    atoms = ["<", ">", "\"", "'", "</", "<p", "<DIV class=\"a\"", "<script", "</script>", "</SCRIPT >", "<style>", "</style>", "<!--", "-->", "<!doctype", "<?x", " a=b", "text", " ", "/>", "<b>", "</b>", "script-x", "=", "<svg/>", "é"]
    for _ in range(6000):
        page = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), m.end(), m[2] or "", m[3], m[4] or "") for m in PATTERN.finditer(page)]
        assert list(html_text.tokens(page)) == want, page


@pytest.mark.parametrize("piece, tail", [
    ("<script x", ""), ("<a x ", ""), ("<a x=\"", ""), ("<a ", "\"\" '' " * 50000), ("<!", ""), ("<div>", "</b>" * 100000), ("</x", "'"),
    ("<a '", "<!-- "), ("<b class=ad>", "</i>" * 100000),
])
def test_a_megabyte_of_unclosed_tags_takes_no_time(piece, tail):
    page = piece * (1_000_000 // len(piece)) + tail
    start = time.process_time()
    html_text.parse(page)
    assert time.process_time() - start < 8
