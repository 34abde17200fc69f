"""Settings that results depend on, in one place.

Lists here are literals of fixed length, so they go into plans as ``IN`` lists.
"""

# MIME types accepted for a book file.
FILE_CONTENT_TYPES = [
    "application/file",
    "application/zip",
    "application/octet-stream",
    "application/x-zip-compressed",
    "application/x-octet-stream",
    "application/gzip",
    "application/pdf",
    "application/ogg",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/x-dvi",
    "application/x-rar-compressed",
    "application/x-tar",
    "multipart/x-zip",
    "application/x-zip",
    "application/x-winzip",
    "application/x-compress",
    "application/x-compressed",
    "application/x-gzip",
    "zz-application/zz-winassoc-arj",
    "application/x-stuffit",
    "application/arj",
    "application/x-arj",
    "multipart/x-tar",
    "text/plain",
]

# Hosts whose URLs carry GBK percent-escapes.
GBK_URL_HOSTS = [
    "www.paofuu.com",
    "down.wmtxt.com",
    "www.txt163.com",
    "down.txt163.com",
    "down.sjtxt.com:8199",
    "file.txtbook.com.cn",
    "www.yyytxt.com",
    "www.27xs.org",
    "down.dusuu.com:8199",
    "down.txtqb.cn",
]

# Hosts whose attachment header is UTF-8 instead of GBK (none known).
UTF8_HEADER_HOSTS: list[str] = []

# File extensions accepted when the name is taken from the URL.
FILE_EXTENSIONS = [".doc", ".txt", ".docx", ".rar", ".zip", ".pdf"]

# Tokens that count as null inside collections.
NULL_TOKENS = [None, "null"]

# Characters trimmed from both ends of a link.
LINK_TRIM = "\t\r\n '\""

# Page markup of the listing and detail pages.
NEXT_TEXT = "下一页"
NEXT_OUTER_CLASS = "k2"
DETAIL_CLASS_PART = "sousuolist"
NAME_CLASS = "zizida"
AUTHOR_CLASS = "xiaoxiao"
DESCRIPTION_CLASS = "lili"
COVER_CLASS = "hong"
DOWNLOAD_CLASS_PART = "xiazai_xiao"
AUTHOR_LABEL_WIDTH = 5

# Prefix of the page cache a listed host is read through.
CACHE_PREFIX = "http://webcache.googleusercontent.com/search?q=cache:"

# Reuse period in days, and limits on one batch of requests.
EXPIRES_DAYS = 30
BATCH_SIZE = 16
BATCH_PER_HOST = 8
DELAY_SECONDS = 1

# Reasons a fetch is refused, and the two states of success.
DOWNLOAD_ERROR = "download-error"
EMPTY_CONTENT = "empty-content"
INVALID_TYPE = "invalid-content_type"
NO_FILENAME = "noaccess-filename"
TRANSPORT_ERROR = "Error downloading"
UNREADABLE_NAME = "unreadable-filename"
CACHED = "cached"
DOWNLOADED = "downloaded"
UPTODATE = "uptodate"

# Metric name prefix, counter keys and rollup rules.
METRIC_PREFIX = "scrapy"
ENQUEUED_KEY = "scheduler/enqueued/redis"
DEQUEUED_KEY = "scheduler/dequeued/redis"
ROLLUP_RULES = [("_min$", "min", 0.1), ("_max$", "max", 0.1), ("_count$", "sum", 0.1)]
ROLLUP_DEFAULT = ("avg", 0.5)

# Store layout.
SHARDS = 3
SHARD_KEYS = ("update_time", "book_name")
CHUNK_BYTES = 256 * 1024
