"""Formats of the landed pages and of URLs, stated as they are because results have to match them."""

EDAY = r"on day ([\d,]+)"
COMMENT_COUNT = r"\.\s*(\d+)\s+comments?\b"
COUNTRY_HREF = r"^/en/main/news/latest/all/([^/]+)/"
PROFILE_HREF = r"^/en/citizen/profile/(\d+)"
PUBLISHED_BY = r"published by (.+?) on day"
COMMENT_ID = r"^comment(\d+)$"
PADDING = r"padding-left:\s*(\d+)px"
COMMENT_TIME = r"Day\s+([\d,]+),\s*(\d{1,2}):(\d{2})"
PUBLISHED_AT = "MMM d yyyy HH:mm:ss"
INDENT_PX = 30
#: A tag whose attributes may hold quoted ">".
TAG_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
#: Scheme and authority of a URL; URLs that name a private host by its address.
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)"
PRIVATE_URL = r"(?i)(://|@)(localhost|127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.|0\.0\.0\.0)"
