import html
import re


def plain(page):
    """The text of the one article, read by plain patterns."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote)\b[^>]*>", article)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", p))).split()) for p in parts]
    return "\n".join(b for b in blocks if b)
