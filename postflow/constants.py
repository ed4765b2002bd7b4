"""Fixed values.

Everything in this file has to equal the data contract of the service this engine replaces
(formats, patterns, word lists, limits); the logic that uses the values lives elsewhere.
"""

# --- fixed values: event bus -------------------------------------------------------------
BUS_SOURCE = "twitter.api.v2"
DETAIL_POST = "Tweet"
DETAIL_INCLUDED = "IncludedTweet"

# --- fixed values: text normalisation ----------------------------------------------------
RETWEET_PREFIX_PATTERN = r"^RT "
URL_PATTERN = r"https?://[\w/;:%#$&?()~.=+\-]+"
HTML_UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
# The white space of ECMAScript, spelled out because Java's \s only knows the ASCII part.
WHITESPACE_PATTERN = (
    r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)
#: The characters of that pattern besides blank and line feed.
ASCII_BLANKS = ("\t", "\r", "\x0b", "\x0c")
OTHER_BLANKS = tuple(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# --- fixed values: routing and filters ---------------------------------------------------
DENIED_CONTEXT_DOMAINS = (
    "Musician",
    "Music Genre",
    "Actor",
    "TV Shows",
    "Multimedia Franchise",
    "Fictional Character",
    "Entertainment Personality",
)
LEGACY_EXTRA_SOURCE_LABEL = "Video Game"
CREATED_PREFIX = "202"
DATE_FLOOR = "2019-12-01T00:00:00.000Z"
CHANGE_EVENTS = ("INSERT", "MODIFY")

# --- fixed values: analysis --------------------------------------------------------------
SUPPORTED_LANGUAGES = ("ar", "hi", "ko", "zh-TW", "ja", "zh", "de", "pt", "en", "it", "fr", "es")
DEFAULT_LANGUAGE = "auto"
TRANSLATION_LANGUAGE = "en"
CACHE_DAYS = 14
DROPPED_ENTITY_TYPES = ("QUANTITY", "DATE")
ENTITY_SCORE_THRESHOLD = 0.8
TRANSLATE_RETRIES = 1
DETECT_RETRIES = 20

# --- fixed values: documents -------------------------------------------------------------
PERMALINK_PREFIX = "https://twitter.com/0/status/"
INDEX_PREFIX = "tweets-"
STATE_STUB = "stub"
NOT_FILTERABLE = ("url", "author.url")

# --- fixed values: batch sizes -----------------------------------------------------------
REPUBLISH_CHUNK = 250
REINDEX_CHUNK = 300
PAGE_SIZE = 50
ARCHIVE_TRIGGER = "900 seconds"
CHANGE_MAX_AGE = "1 day"

# --- fixed values: user dictionary (surface, segmentation, reading, part of speech) ------
USER_DICTIONARY = """\
スタートアップ,スタートアップ,スタートアップ,一般名詞
ベンチャーキャピタル,ベンチャーキャピタル,ベンチャーキャピタル,一般名詞
自動翻訳,自動翻訳,ジドウホンヤク,一般名詞
機械翻訳,機械翻訳,キカイホンヤク,一般名詞
機械学習,機械学習,キカイガクシュウ,一般名詞
深層学習,深層学習,シンソウガクシュウ,一般名詞
強化学習,強化学習,キョウカガクシュウ,一般名詞
自動運転,自動運転,ジドウウンテン,一般名詞
ブロックチェーン,ブロックチェーン,ブロックチェーン,一般名詞
データストア,データストア,データストア,一般名詞
サーバーレス,サーバーレス,サーバーレス,一般名詞
サーバレス,サーバレス,サーバーレス,一般名詞
サービスメッシュ,サービスメッシュ,サービスメッシュ,一般名詞
セッションマネージャー,セッションマネージャー,セッションマネージャー,固有名詞
k8s,k8s,kubernetes,一般名詞
node.js,node.js,node.js,固有名詞
react.js,react.js,react.js,固有名詞
vue.js,vue.js,vue.js,固有名詞
web3,web3,web3,一般名詞
web3.0,web3.0,web3.0,一般名詞
"""

# --- fixed values: synonym groups, the first term represents the group --------------------
SYNONYM_GROUPS = """\
api gateway,apigateway,api gw,apigw
app mesh,appmesh,アップメッシュ
app runner,apprunner,アップランナー
backup,backups,バックアップ
blockchain,ブロックチェーン
containers,container,コンテナ
database,db,データベース
data lake,datalake,データレイク
deep learning,ディープラーニング,深層学習
kubernetes,k8s
machine learning,ml,マシンラーニング,機械学習
network,ネットワーク
reinforcement learning,強化学習
server,サーバー,サーバ
serverless,サーバーレス,サーバレス
service mesh,サービスメッシュ
session manager,セッションマネージャー
solutions architect,sa,ソリューションアーキテクト
startup,startups,スタートアップ
storage,ストレージ
systems manager,ssm
venture capital,vc,ベンチャーキャピタル
web3,web3.0
"""
