"""Problem 1: template residue, filler and error pages instead of content.

Every line is masked (numbers, addresses, identifiers, dates, and units that
only repeat) and hashed; equal hashes are one message, and messages are grouped
exactly over books and sites. What recurs is then classified once a message:
by phrase patterns of several languages, which must make up most of the
message, or by company, when it stands mostly on pages of such messages with
no line of their own. Placeholders are told inside a sentence as well, by their delimiters,
so that these need no recurrence; neither does Latin filler, which never
comes twice alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.chapters import NARROW, NUMERAL, WIDE, lines_of, table
from inkloom.session import cut, few, spread

#: A message must occur in this many books.
RECUR = 2
#: Share of a message's letters that phrases must explain.
EXPLAINED = 0.6
#: Share of a line's chapters that hold told messages and recurring lines only, from which its company tells, and their books.
COMPANY, COMPANY_BOOKS = 0.5, 2

_NAME = r"[A-Za-z_一-鿿][\w一-鿿.|\-]*"
#: Delimiters of template languages around a name, and what programs print for nothing (fixed values).
PLACEHOLDER = "(?=[{<$#\\[%@_&‹])(?:" + "|".join(
    (
        rf"\{{\{{\s*{_NAME}\s*\}}\}}",
        rf"\{{%\s*{_NAME}\s*%\}}",
        rf"<%=?\s*{_NAME}\s*%>",
        rf"[$#]\{{\s*{_NAME}\s*\}}",
        rf"\{{\$?{_NAME}\}}",
        r"\{[0-9]{1,2}\}",
        rf"\[\[\s*{_NAME}\s*\]\]",
        rf"\[%\s*{_NAME}\s*%\]",
        r"\[(?:INSERT|ENTER|ADD|YOUR|TITLE|NAME|TEXT|CONTENT)(?:[ _][A-Z]+)*\]",
        rf"\$\${_NAME}\$\$",
        rf"@@{_NAME}@@",
        rf"(?<![0-9A-Za-z_一-鿿])%{_NAME}%(?!\w*%)|(?<=[一-鿿])%[A-Za-z_][\w.]*%|(?<=[一-鿿])%[一-鿿]+%",
        r"%\([A-Za-z_]\w*\)[sd]",
        r"__[A-Za-z一-鿿](?:[\w一-鿿.|\-]*[A-Za-z一-鿿])?__",
        rf"‹{_NAME}›",
        rf"&lt;/?{_NAME}/?&gt;",
        r"<[A-Za-z_一-鿿][\w一-鿿.]*/>",
    )
) + ")"
NOTHING = r"(?<![A-Za-z])(?:undefined|null|NaN|\[object Object\])(?![A-Za-z])"
NOTHING_LINE = r"(?i)\b(?:undefined|null|nan|nil|none|n/a)\b|\[object object\]"

#: Function words: Latin text without any of them is filler (fixed values).
COMMON = (
    "the of and to in is for on at you we this that with your are be no not or it by as please read more all only need back error "
    "de la le les et en un une des que du est pas dan yang di ini itu tidak untuk cua va la khong mot co cho voi duoc trong nguoi "
    "he she they was were has have had his her but from like if so can will went something nothing who what "
    "http loading copyright tags chapter vol"
)

#: Phrases of messages, by kind and language; ``S`` stands for a short stretch without a full stop (fixed values).
PHRASES = {
    "status": (
        r"\b[45]\d\d\b\W*(?:error|错误|not found|forbidden|unauthorized|gone|bad gateway|too many|internal|service|gateway|request|nginx|apache)",
        r"\b(?:error|http|status|code|lỗi|erreur|kesalahan|错误|错误码|错误代码|状态码|代码|出错了?)\W{0,3}(?:code|js|no)?\W{0,3}\d{1,4}\b",
        r"^\W*[45]\d\d\W*$",
        r"\b(?:trace|request|ray|correlation|incident|reference)[ _-]?(?:id)?\W{0,3}(?=[0-9a-f-]*\d)[0-9a-f-]{6,}\b|(?:请求编号|追踪编号|时间戳|请求 ?id)\W{0,3}[0-9a-f-]{6,}",
        r"\b(?:bad|invalid|malformed) request\b|\bunauthorized\b|^\W*forbidden\W*$|\bbad gateway\b|\bgateway time-?out\b",
    ),
    "gone": (
        r"\b(?:page|url|resource|file|document|content|link|chapter|template|address|article)\bS(?:not (?:be )?(?:found|located)|n[o']t (?:exist|be found|found)|no longer|moved|removed|deleted|unavailable|expired|gone|missing)\b",
        r"\b(?:can(?:no|')t|could not|unable to) (?:find|locate)\b",
        r"(?:页面?|网页|网址|地址|链接|内容|章节|正文|资源|文件|文章|本章|数据|信息)T(?:不存在|找不到|没找到|未找到|走丢|丢失|已?(?:经|被)?(?:删除|下架|搬走|移除|屏蔽|失效|转移)|为空|审核中|待补|补充中)",
        r"(?:找不到|未找到|没有找到|不存在)T(?:页面?|网页|网址|地址|链接|内容|章节|资源|文件)",
        r"(?:您|你)(?:要|所|想)?(?:找|访问|查看|请求|浏览)的T(?:页面?|网页|内容|资源|章节)",
        r"(?:trang|nội dung|liên kết|chương|tệp)S(?:không (?:tồn tại|tìm thấy)|đã bị (?:xóa|gỡ))|không tìm thấy (?:trang|nội dung|chương|tệp)",
        r"page introuvable|(?:page|contenu)S(?:n'existe|introuvable|supprimée?)",
        r"(?:halaman|konten|tautan)S(?:tidak (?:ditemukan|ada|tersedia)|dihapus)",
        r"(?:ページ|コンテンツ|ファイル)S(?:見つかりません|存在しません|削除されました)",
    ),
    "access": (
        r"\b(?:access|permission|request)\bS(?:denied|forbidden|blocked|refused|rejected)\b|\bpermission to (?:view|access|see)\b|\battention required\b",
        r"(?:没有|无|暂无|缺少)T权限|权限不足|无权(?:访问|查看|浏览)|(?:访问|请求|连接)(?:已?被|遭到|受到)?(?:拒绝|禁止|拦截|限制)|(?:禁止|拒绝|无法)访问",
        r"không có quyền|truy cậpS(?:từ chối|bị chặn)|từ chối truy cập|accès (?:refusé|interdit)|akses (?:ditolak|dilarang)|アクセスS(?:拒否|禁止)",
        r"(?:会话|登录|登陆|凭证|令牌)(?:状态)?已?经?(?:过期|失效|超时|到期)|\bsession\bS(?:expired|timed out|ended)\b|phiênS(?:hết hạn)",
        r"(?:访问|请求|操作|点击|刷新)(?:次数)?(?:过于|太过|过|太)(?:频繁|多|快)|\btoo many (?:requests|connections|attempts)\b|\brate limit|quá nhiều (?:yêu cầu|lượt)|trop de requêtes",
        r"(?:验证码|安全验证|人机验证)|\bsecurity check\b|\bverify(?:ing)?\b.{0,12}\bhuman\b|\bchecking your browser\b|\bddos protection\b|^\W*just a moment\W*$",
    ),
    "server": (
        r"\b(?:server|gateway|service|site|website|system|database|connection|network|upstream|host|backend)\bS(?:error|busy|overload(?:ed)?|unavailable|timed? ?-?out|refused|reset|down|maintenance|failed|gave no|unable|not respond(?:ing)?|interrupted)\b",
        r"\b(?:error|unable|failed|failure|cannot|could not|can't)\bS(?:server|database|connect(?:ion)?|load|fetch|content|establish|respond)\b|\brequest (?:failed|timed? ?-?out)\b",
        r"(?:服务器?|网关|数据库|后端|接口|系统|网络|网站|本站|站点|线路|程序|连接|主机)T(?:错误|异常|繁忙|拥挤|超时|过载|故障|失败|维护|中断|断开|重置|不可用|开小差|崩溃|宕机|不给力|无响应|未响应|空值|出错|返回空|升级)",
        r"(?:数据|正文|页面|内容|章节)?(?:加载|读取|获取|载入|请求|响应|连接)(?:失败|超时|出错|异常|错误)|(?:无法|不能|未能)(?:访问|连接|打开|加载|显示|呈现|获取)",
        r"(?:máy chủ|hệ thống|kết nối|cơ sở dữ liệu|mạng|dịch vụ)S(?:lỗi|bận|bảo trì|quá tải|không phản hồi|gián đoạn|thất bại)|(?:lỗi|không thể)S(?:kết nối|máy chủ|hệ thống|tải)|(?:xảy ra|có) lỗi",
        r"(?:serveur|service|connexion|système)S(?:erreur|occupé|indisponible|maintenance|interrompue)|erreur (?:interne|du serveur|de connexion)|erreur est survenue",
        r"(?:server|sistem|koneksi)S(?:kesalahan|sibuk|gangguan|pemeliharaan|gagal)|terjadi kesalahan|gagal memuat",
        r"(?:サーバー?|システム|接続|ネットワーク)S(?:エラー|できません|混み合|タイムアウト)|エラーが発生|メンテナンス",
        r"\bsomething (?:went wrong|broke|is broken)\b|\b(?:unexpected|unknown|fatal|internal|uncaught)(?: \w+)? (?:error|exception|condition)\b|\berror (?:has )?occurred\b|\bisn't working\b|\b(?:for|under|down for) maintenance\b|\bbe (?:right )?back soon\b",
        r"(?:未知|系统|网络|内部|参数|请求|程序|数据库|服务器)(?:参数|内部)?(?:错误|异常)|(?:发生|出现)了?(?:未知|内部)?(?:错误|异常)",
    ),
    "script": (
        r"\b(?:enable|turn(?:ing)? on|activate|allow|requires?|needs?|without|disabled?|blocked)\bS(?:javascript|js|scripts?|scripting|cookies?)\b|\b(?:javascript|js|scripts?|scripting|cookies)\bS(?:on|off|disabled|required|blocked|enabled|not supported)\b",
        r"(?:开启|启用|打开|允许|需要|不支持|支持|禁用|关闭|拦截)T(?:javascript|\bjs\b|脚本|cookie|阅读器)|(?:javascript|\bjs\b|脚本|cookie)T(?:被|已|未|关闭|禁用|启用|开启|打开|不可用|拦截|支持)",
        r"(?:如何|怎样|怎么)(?:开启|启用|打开)\W*(?:点此|点击|点这里|查看)",
        r"(?:浏览器|阅读器|客户端)T(?:过旧|过低|太旧|太低|不支持|不兼容|升级|更新)|(?:更换|升级|更新)T浏览器",
        r"\bbrowser\bS(?:out of date|outdated|not supported|unsupported|too old)\b|\b(?:update|upgrade) your browser\b",
        r"(?:bật|tắt|kích hoạt|hỗ trợ|cần)S(?:javascript|cookie)|trình duyệtS(?:cũ|không hỗ trợ|cập nhật)",
        r"(?:activer|activez|nécessite|désactivé|requiert)S(?:javascript|cookies)|navigateurS(?:à jour|obsolète|pris en charge)",
        r"(?:aktifkan|butuh|membutuhkan)S(?:javascript|cookie)|javascriptS(?:有効|無効|オン)|ブラウザS(?:対応|古い|更新)",
    ),
    "wait": (
        r"^\W*(?:\w+ ){0,3}(?:is |now )?loading\b|\bplease wait\b|\bredirecting\b|đang tải|chargement|veuillez patienter|memuat|読み込み中|お待ち",
        r"(?:加载|载入|读取|获取|手打|跳转|转码)(?:中|\W*\d+ ?%)|正在(?:为您)?(?:加载|载入|读取|获取|手打|跳转|转码)",
    ),
    "action": (
        r"^\W*(?:请?(?:联系|咨询)(?:管理|值班|技术|客服)?(?:人员|员|客服|站长)|(?:点击)?重新(?:载入|加载|尝试)|(?:点击)?重试|(?:点击)?刷新(?:页面|重试)?|返回(?:首页|上页)|\w{1,4}秒后(?:自动)?跳转|back|go back|retry|reload|refresh|try again)\W*$",
    ),
    "filler": (
        r"\blorem\b|\bipsum\b|\bplaceholder\b|\b(?:sample|dummy|example|filler) (?:text|content|title)\b|\b(?:insert|enter|add|type|your)\b(?: your)?(?: \w+)? (?:here|goes here)\b|^\W*(?:todo|tbd|fixme)\b|^\W*test(?:ing)?(?:\W+(?:test(?:ing)?|\d+))+\W*$",
        r"占位|(?:示例|样例|测试|范例)(?:段落|文字|文本|内容|数据|测试)|(?:填写|输入|插入|替换为|补充?)T(?:章节|实际|正文|标题|文字|文本|内容)|仅供(?:排版|测试|演示|展示|预览)|待补|待填|甲乙丙丁戊|暂无(?:内容|数据|正文|简介)|正文正文",
    ),
}

#: What else such messages are made of; it explains letters and tells nothing by itself (fixed values).
COURTESY = (
    r"请?(?:您|你)?(?:稍后|稍候|稍等|片刻|重新|再次|重|再|返回|点击|刷新|更换|联系|等待|检查|尝试|休息|歇|登录|加载|打开|进入|访问|查看|继续|操作|回来|来|试|次)+(?:一下|一会儿?|一次|此页|本页|首页|页面|网络|浏览器|线路|管理员|人员|客服|再|后)*",
    r"页面?|网页|网址|地址|链接|章节|内容|正文|资源|文件|数据|浏览器|阅读器|版本|服务器?|系统|网站|网络|脚本|javascript",
    r"对不起|抱歉|很遗憾|您的?|你的?|当前|本页|此页|该页|本章|该|已经?|或者?|被|后才能|预计\S{0,4}恢复|设置里?|功能|请在?|检测到|显示|的|了",
    r"(?:sorry|oops|whoops|please|try|again|later|retry|reload|refresh|back|check|contact|the|page|we|our|your?|to|continue|and|or|in|soon|moment|log|sign|this)\b",
    r"(?:vui lòng|xin|hãy|thử lại|sau|quay lại|để đọc|để tiếp tục|bật lại|trang|bạn|yêu cầu)",
    r"(?:veuillez|réessayer|plus tard|silakan|coba lagi|nanti|anda|しばらく|ください|ただいま|お使いの)",
)
#: Marks of telling: someone speaks, thinks or is spoken of (fixed values).
TELLING = r"[他她它]|[说问喊道]：|低声|笑道|心想|\b(?:he|she|his|her|they|said|asked)\b|(?:hắn|nàng|chàng|nói|hỏi)\b|“.*”|「.*」"

#: Units of two or three letters that are filler when they repeat; others are sounds (fixed values).
UNITS = ("测试", "正文", "内容", "文字", "文本", "示例", "占位", "样例", "test", "text", "abc", "asdf", "xxx")
_GARBLED = frozenset("锟斤拷烫屯")

_SPLIT = re.compile(r"[\W_]+")


def _phrase(text: str) -> str:
    """A pattern with its stretches: S has no end of a sentence, T is a few Han characters without a mark."""
    return text.replace("S(", r"[^.!?;。！？；]{0,60}?(").replace(")S", r")[^.!?;。！？；]{0,60}?").replace("T(", "[^，。！？；,.!?;“”]{0,6}(").replace("T", "[^，。！？；,.!?;“”]{0,6}")


_KINDS = {kind: re.compile("|".join(map(_phrase, p)), re.IGNORECASE) for kind, p in PHRASES.items()}
#: A clause around a Latin phrase is explained by it; of Chinese and Japanese only the phrase and a few signs are.
_EXPLAIN = re.compile(
    "|".join(
        rf"(?:[^.!?;,。！？；，⺀-鿿]*(?:{_phrase(p)})[^.!?;,。！？；，⺀-鿿]*)" for kind in PHRASES for p in PHRASES[kind]
    ),
    re.IGNORECASE,
)
_COURTESY = re.compile("|".join(COURTESY), re.IGNORECASE)
_TELLING = re.compile(TELLING, re.IGNORECASE)


def plain(line: str) -> str:
    return unicodedata.normalize("NFKC", line).casefold()


def repeated(bare: str) -> str | None:
    """The unit that a text repeats three whole times or more, with nothing but the start of another behind."""
    found = re.match(r"(.+?)\1\1+", bare, re.S)
    if not found:
        return None
    unit = found[1]
    return unit if (unit * (len(bare) // len(unit) + 1)).startswith(bare) else None


def classify(line: str) -> str | None:
    """The kind of a recurring message, None for any other line."""
    text = plain(line).strip()
    bare = _SPLIT.sub("", text)
    if not bare:
        return None
    unit = repeated(bare)
    if unit is not None and len(bare) >= 6:
        if _GARBLED & set(unit):
            return None
        if len(set(unit)) == 1:
            return "filler" if unit[0].isascii() else None
        return "filler" if len(unit) >= 4 or unit in UNITS else None
    if _TELLING.search(text):
        return None
    for kind, pattern in _KINDS.items():
        if pattern.search(text):
            left = _SPLIT.sub("", _COURTESY.sub("", _EXPLAIN.sub("", text)))
            return kind if len(left) <= (1 - EXPLAINED) * len(bare) else None
    return None


_PLACEHOLDER, _NOTHING, _COMMON = re.compile(PLACEHOLDER), re.compile(NOTHING), frozenset(COMMON.split())


def told(line: str) -> bool:
    """Whether a line is residue by itself, or would be if it recurred."""
    if _PLACEHOLDER.search(line) or _NOTHING.search(line) and "“" not in line:
        return True
    if line.isascii() and len(line) >= 24:
        words = re.findall("[A-Za-z]+", line)
        if len(words) >= 4 and sum(map(len, words)) >= 0.75 * len(line) and _COMMON.isdisjoint(w.lower() for w in words):
            return True
    return classify(line) is not None


def read(source: Column) -> Column:
    """Paragraphs of a JSON array of strings; of one that breaks off, those there are, the last perhaps in part."""
    torn = F.regexp_replace(source, r"\\u?[0-9a-fA-F]{0,3}$", "")
    ends = [F.lit('"]'), F.lit("]"), F.lit('""]')]
    broken = F.when(F.ltrim(source).startswith("["), F.coalesce(*(lines_of(F.concat(torn, e)) for e in ends)))
    return F.coalesce(lines_of(source), broken)


def formed(lines: Column) -> Column:
    """Lines without addresses, identifiers, numbers, dates, marks, spacing, width and case; of what only repeats, the unit.

    Step by step over the array: a step's result is computed once a line,
    however often the next one reads it.
    """
    text = F.transform(lines, lambda x: F.lower(F.translate(x, WIDE, NARROW)))

    def latin(x: Column) -> Column:
        # Addresses and identifiers have Latin letters; most lines have none.
        free = F.regexp_replace(F.regexp_replace(x, r"https?://[!-~]+|[a-z0-9-]+\.[a-z]{2,}[!-~]*", "0"), r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b", "0")
        return F.when(x.rlike("[a-z]"), free).otherwise(x)

    bare = F.transform(
        F.transform(text, latin), lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\p{M}]+", ""), NUMERAL, "0")
    )

    def unit(x: Column) -> Column:
        again, rest = (F.regexp_extract(x, r"^(.+?)\1\1+(.*)$", k) for k in (1, 2))
        return F.when(x.rlike(r"^(.+?)\1\1") & F.startswith(again, rest), F.concat(F.lit("×"), again)).otherwise(x)

    return F.transform(bare, unit)


def inside(line: Column) -> Column:
    """Whether a line holds a placeholder or a printed nothing, or is Latin filler: told by the line itself."""
    words = "|".join(COMMON.split())
    # Most lines have none of the signs that any of these need.
    able = line.rlike(r"[A-Za-z{<$#\[%@_&‹]")
    latin = (
        line.rlike(r"[A-Za-z]\P{L}+[A-Za-z]+\P{L}+[A-Za-z]+\P{L}+[A-Za-z]")
        & ~line.rlike("[^\\x00-\\x7f]")
        & (F.length(line) >= 24)
        & (F.length(F.regexp_replace(line, r"[^A-Za-z]", "")) >= 0.75 * F.length(line))
        & ~line.rlike(rf"(?i)\b(?:{words})\b")
    )
    told = (
        line.rlike(PLACEHOLDER)
        | (line.rlike(NOTHING) & ~F.contains(line, F.lit("“")))
        | (line.rlike(NOTHING_LINE) & ~F.regexp_replace(line, NOTHING_LINE, "").rlike(r"[\p{L}\p{N}]"))
        | latin
    )
    return F.when(able, told).otherwise(False)


def forms(chapters: DataFrame) -> DataFrame:
    """``book_id, number, book, residue, keys, raws``: for each line whether it is residue by itself, and the hashes of its form and of itself."""
    lines = chapters.select("book_id", "number", read(F.col("source")).alias("lines")).filter("lines is not null")
    return lines.select(
        "book_id",
        "number",
        # A book is where a message comes from; rows without one share the source ''.
        F.xxhash64(F.coalesce("book_id", F.lit(""))).alias("book"),
        F.transform("lines", lambda x: F.coalesce(inside(x), F.lit(False))).alias("residue"),
        F.transform(formed(F.col("lines")), lambda x: F.when(x != "", F.xxhash64(x))).alias("keys"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("raws"),
    )


def messages(pages: DataFrame, chapters: DataFrame, recur: int = RECUR) -> DataFrame:
    """``key`` of every recurring message that phrases or company tell.

    ``pages`` are `forms` of ``chapters``, cut from their lineage.
    """
    lines = pages.select("book_id", "number", "book", F.explode(F.arrays_zip("keys", "raws")).alias("x"))
    lines = lines.select("book_id", "number", "book", F.col("x.keys").alias("key"), F.col("x.raws").alias("raw"))
    counts = lines.filter("key is not null").groupBy("key", "book").agg(F.count("*").alias("n"), F.min("raw").alias("raw"))
    often = cut(
        counts.groupBy("key").agg(F.count("*").alias("books"), F.min("raw").alias("raw")).filter(F.col("books") >= recur).select("key", "raw")
    )
    recurring = few(often)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [classify(x) for x in batch["line"]]
            yield batch.loc[[k is not None for k in kinds], ["key"]]

    # One line of each recurring message is read again, by its hash.
    texts = chapters.select(F.explode(read(F.col("source"))).alias("line")).select("line", F.xxhash64("line").alias("raw"))
    told = cut(texts.join(recurring, "raw").groupBy("key").agg(F.min("line").alias("line")).mapInPandas(judge, "key long"))
    # Pages on which every line recurs and one is told hold no story: what stands mostly there is told as well.
    marked = lines.join(recurring.select("key", F.lit(1).alias("known")), "key", "left").join(
        few(told).select("key", F.lit(1).alias("told")), "key", "left"
    )
    pages_of = marked.groupBy("book_id", "number", "book").agg(
        (F.expr("count_if(known = 1 or key is null) = count(*)") & F.expr("count_if(told = 1) > 0")).alias("alone"),
        F.collect_set(F.expr("if(known = 1, key, null)")).alias("keys"),
    )
    company = (
        pages_of.select("book", "alone", F.explode("keys").alias("key"))
        .groupBy("key", "book")
        .agg(F.count("*").alias("n"), F.expr("count_if(alone)").alias("alone"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.expr("count_if(alone > 0)").alias("books"))
        .filter((F.col("alone") >= COMPANY * F.col("n")) & (F.col("books") >= COMPANY_BOOKS))
        .select("key")
    )
    return cut(told.unionByName(company).distinct())


def find(chapters: DataFrame, recur: int = RECUR) -> DataFrame:
    """``book_id, number`` of every chapter of ``book_id, number, source`` with residue; may repeat.

    Null and empty sources and those that aren't arrays have none; of an array that breaks off, what there is counts.
    """
    pages = cut(forms(chapters))
    told = messages(pages, chapters, recur)
    alone = F.exists("residue", lambda x: x)
    lines = pages.filter(~alone).select("book_id", "number", F.explode("keys").alias("key"))
    return pages.filter(alone).select("book_id", "number").unionByName(lines.join(few(told), "key", "left_semi").select("book_id", "number"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number`` of every chapter with residue in at least one paragraph."""
    return find(spread(table(spark, sf_dir, "chapters").select("book_id", "number", "source"))).distinct()
