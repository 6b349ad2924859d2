r"""Problem 9: documents with template residue, filler, error-page messages or notices that scripts are required.

Method: the normalised lines of all documents are counted by host (the source); lines that recur across many documents of a
host are its boilerplate and are subtracted, whatever they say; what is left of a document is searched for evidence, sentence
by sentence. So a notice in the footer of every page takes no page with content away. A document of which nothing is left
has no content of its own: it is found if its lines, boilerplate or not, show evidence, and kept if they do not.

Evidence is structural where it can be: template syntax that was not filled, values printed for nothing where a value
stands, status lines, exceptions and stack traces, notices that open a clause, repeated phrases, pseudo Latin. Sentences that
talk about templates, errors or scripts, and blanks for examinees, are no evidence.

Defined cases: null, empty and blank texts are never found. A null source is a host of its own. Width, look-alike letters,
invisible characters, the kind of blank and letter case do not matter. Texts are read whole. Repeated rows are judged
alike; boilerplate is counted by document, not by row, where ids repeat. A text whose lines left over are one letter
repeated is filler. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.llm.lookalike import _Table, fold_char
from examloom.session import materialize

#: A line is boilerplate of its host if it stands in so many of its documents and in this share of them.
LEAST_DOCS, LEAST_SHARE = 5, 0.002

KINDS = ("placeholder", "script_required", "error", "filler")
_HAN = "㐀-鿿"
# Nouns that name what a template fills in, Chinese ones as the end of a phrase.
_NOUN_ZH = "(?:姓名|名称|名字|药品名|用户名|日期|时间|地址|电话|邮箱|编号|科室|单位|年龄|性别|标题|题干|题目|选项|答案|解析|内容|正文|得分|分数|成绩|公司|作者|来源|链接|图片|学校|城市|金额|数量)"
_NOUN_EN = (
    "(?:answers?|questions?|options?|stem|title|body|hint|score|explanation|rationale|content|name|first ?name|last ?name|full ?name|user ?name|user|company|organi[sz]ation|email|e-mail|address|phone|city|country|state"
    "|amount|url|link|author|product|order|price|image|date|time|department|hospital|school|subject|topic|text|placeholder|recipient|sender|customer|client|position|role)"
)
_ID = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"  # words joined by low lines
_FIELD = rf"(?:{_ID}|{_NOUN_EN}|[{_HAN}]{{0,4}}{_NOUN_ZH}[a-g]?)"
_NAME = rf"(?:[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*|[{_HAN}a-z]{{2,8}})"
_NOTHING = r"(?:undefined|null|nan)"
_SCRIPT = r"(?:java ?script|ecmascript|(?<![a-z])js(?![a-z])|脚本|(?<![a-z])scripts?(?![a-z])|scripting|client-side code)"
_PARTY = "(?:系统|服务器?|网络|接口|数据库|页面|网页|网站|站点|后台|程序|请求|连接|访问)"
_THING = "(?:页面|网页|内容|题目|试题|条目|链接|资源|文件|文章|帖子|视频|商品|网址|地址)"
# Reason phrases of status lines.
_REASON = (
    "(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |site )?not found|(?:method )?not allowed|not acceptable|request time-?out|conflict|(?:page )?gone|too large|too many requests"
    "|internal (?:server )?error|server error|not implemented|bad gateway|(?:service )?unavailable|gateway time-?out|access denied|session expired|connection (?:refused|reset)|something went wrong|upstream connect failure)"
)
#: What may stand before a notice in its sentence.
_OPEN = r"^(?:\W|oops|whoops|uh-oh|sorry|error|warning|notice|alert|message|抱歉|很抱歉|非常抱歉|对不起|提示|系统提示|系统消息|注意|温馨提示|the|this|your|an?|您|你|当前|本|该|\d+[.)])*"

#: (kind, what a line must hold, pattern of a folded sentence). A line without any of the strings cannot match the pattern.
RULES: list[tuple[str, tuple[str, ...], str]] = [
    ("placeholder", ("{{",), rf"\{{\{{\{{?[~#/^>!&-]? ?{_NAME}[^{{}}\n]{{0,80}}(?:\}}\}}|$)"),
    ("placeholder", ("<%",), r"<%[-=#@]? ?[^%<>\n]{1,80}%>"), ("placeholder", ("{%",), r"\{%-? ?[^%{}\n]{1,80}%\}"),
    ("placeholder", ("${", "#{"), r"[$#]\{ ?[^{}\n]{1,60}\}"), ("placeholder", ("[[",), rf"\[\[ ?{_NAME} ?\]\]"), ("placeholder", ("@@",), rf"@@ ?{_NAME} ?@@"),
    ("placeholder", ("$",), rf"\${_FIELD}\$"), ("placeholder", ("__",), rf"(?<![a-z_])__{_FIELD}__(?![a-z_])"), ("placeholder", ("#",), rf"#{_FIELD}#"),
    ("placeholder", ("%(",), rf"%\({_NAME}\)[sdf]"), ("placeholder", ("%s", "%d"), r"(?<![\d%a-z])%[sd](?![a-z0-9])"),
    ("placeholder", ("{",), rf"(?<![\\a-z^_}}])\{{(?:[a-z][a-z0-9_.]{{2,}}|[{_HAN}]{{2,8}}[a-g]?|\d)\}}"),
    ("placeholder", ("[",), rf"(?<![a-z0-9\]])\[{_FIELD}\](?!\((?:https?:|/|#|www|mailto))"), ("placeholder", ("<",), rf"<(?:{_ID}|[{_HAN}]{{0,4}}{_NOUN_ZH}[a-g]?|(?!(?:title|body|time|link|image|address|text|content)>){_NOUN_EN})>|(?:(?<=[^\s>])|(?<=[a-z0-9] )(?=<[a-z]+> [a-z0-9]))<(?:title|body|time|link|image|address|text|content)>(?!.*</)"),
    ("placeholder", ("x", "×"), rf"[×x]{{2}}{_FIELD}[×x]{{2}}"), ("placeholder", ("xxx",), r"(?<![a-z])x{3}(?![a-z])"),
    ("placeholder", ("[", "(", "【", "〔", "〈", "<", "{"), r"[\[(【〔〈<{][^\]\[)(】【〔〕〈〉<>{}]{0,10}(?:待填|占位|待补充?|此处填写|请填写|请输入|此处插入|此处输入)[^\]\[)(】【〔〕〈〉<>{}]{0,12}[\])】〕〉>}]"),
    ("placeholder", ("[", "<", "{", "(", "【"), r"[\[<{(【](?:please )?(?:insert|your|add|enter|type|put|fill in|write|replace)[ _][a-z0-9 _'-]{2,50}[\]>})】]"),
    ("placeholder", ("[object",), r"\[object [a-z]+\]"), ("placeholder", ("#",), r"#(?:ref|n/a|value|name|div/0|null|num)[!?]"),
    ("placeholder", ("$",), r"(?:^|[^\d\s.,(/])\$[1-9](?=[^\d\s.,)/-])|(?:hello|hi|dear) \$[1-9]|亲爱的\$[1-9]|[:.] ?\$[1-9]$|(\$[1-9])(?![\d.,]\d)(?! ?(?:per|a|each|and|to|million|billion)(?![a-z])).{1,40}\1(?![\d.,]\d)(?! ?(?:per|a|each|million|billion)(?![a-z]))"),
    ("placeholder", ("undefined", "null", "nan", "none"), rf"(?:[:=] ?|^(?:dear|hello|hi|welcome),? )(?:{_NOTHING}|none)(?![a-z_\"'])(?: ?[.,;!。]|$)|(?<=[{_HAN}《(:=]){_NOTHING}(?=[{_HAN}》,。、;/%)°]|$)|(?<=[{_HAN}])none(?![a-z])|(?<![a-z])none(?=[{_HAN}])|(?<=[-<>=≥≤~]){_NOTHING}(?![a-z_\"'])"),
    ("placeholder", ("undefined", "null", "nan"), rf"(?<![a-z_\"']){_NOTHING}(?![a-z_\"']).{{0,60}}(?<![a-z_\"']){_NOTHING}(?![a-z_\"'])|(?<![a-z_\"']){_NOTHING} ?(?:mg|ml|kg|cm|mmhg|岁|例|分)(?![a-z])|^{_NOTHING}$|(?:than|every|after|about) (?:undefined|nan) [a-z]+s(?![a-z])|(?<![a-z_\"'])undefined.{{0,60}}(?<![a-z_\"'])undefined|(?<![a-z])undefined(?:mg|ml|kg|cm|mmol|μmol|ng|pg|g/l|u/l|iu)|(?<=[<>=约-])undefined"),
    ("placeholder", ("none",), r"(?:hello|hi|dear) none[,!].*|(?<![a-z])none(?![a-z]).{1,40}(?:about|on|for|of|is) none[.!]?$|: none(?:\W|$).*: none(?:\W|$)|(?<![a-z])none (?:[a-z]+ ){1,2}none(?![a-z]| of)"),
    ("script_required", ("script", "js", "client-side"), rf"(?:enable|allow|turn(?:ed)? on|switch(?:ed)? on|activate|needs?|requires?|required?|without|blocks?|blocked|disabled?|must be|support) .{{0,24}}{_SCRIPT}(?!\w)(?!.{{0,12}}(?:developer|library|file))"),
    ("script_required", ("script", "js", "client-side"), rf"{_SCRIPT}.{{0,30}}(?:disabled|must be (?:allowed|enabled|on)|(?:is|are) (?:off|required|blocked|disabled|not (?:enabled|supported|available))|to be enabled|turned off|switched off)"),
    ("script_required", ("js", "脚本", "script", "client-side"), rf"(?:启用|开启|允许|打开|禁用|需要|未检测到|未开启|未启用|不支持|支持|关闭|运行|屏蔽).{{0,8}}{_SCRIPT}.{{0,24}}(?:查看|访问|提交|继续|显示|加载|答题|刷新|支持|无法|后|才能|方可|浏览|$|!)"),
    ("script_required", ("js", "脚本", "script", "client-side"), rf"{_SCRIPT}.{{0,6}}(?:被拦截|被禁用|被屏蔽|被阻止|未开启|已禁用|未启用|未运行|不可用|已关闭|支持,)"),
    ("error", ("http", "error", "status"), r"(?<![a-z])http(?:/\d(?:\.\d)?)? ?(?:error|status)?(?: code)? ?[:#]? ?[45]\d\d(?!\d)|(?<![a-z])(?:error|status)(?: code)? ?[:#]? ?[45]\d\d(?![\d.])"),
    ("error", ("4", "5"), rf"^(?:\W|the|error)*[45]\d\d(?!\d) ?[-–|:.]? ?{_REASON}|<h\d>[45]\d\d|<title>[45]\d\d"),
    ("error", ("error", "exception"), r"^(?:\W)*(?:(?:fatal|uncaught|unhandled|runtime|parse|syntax|internal|server|application|database|sql|script|unexpected|critical|connection) )*(?:[a-z_.]*(?:error|exception)) ?: ?(?=[a-z'\"{\[$])|(?<![a-z])[a-z]{3,}(?:error|exception) ?: ?(?=['\"\w])"),
    ("error", ("error",), r"(?<![a-z])error \d{1,5} ?\([a-z0-9]+\)|\"(?:error|errors)\" ?: ?[{\[\"]|fatal error|an? (?:internal|unexpected|unknown|fatal) (?:server )?error (?:has )?occurr?ed|error (?:loading|connecting|establishing|rendering|processing)"),
    ("error", ("\"status\"", "\"code\"", "\"success\""), r"\"status\" ?: ?\"(?:fail|denied|error|unauth|forbid)|\"code\" ?: ?[45]\d\d|\"success\" ?: ?false"),
    ("error", ("traceback", "stack trace", "segmentation", "core dumped", "line ", "(", "undefined"), r"traceback \(most recent|stack trace|segmentation fault|core dumped|(?<![a-z])at [a-z_$]+(?:\.[a-z_$<>]+)+\([a-z_]+\.[a-z]{1,5}:\d+\)|file \"[^\"]{1,80}\", line \d+|(?:warning|notice|fatal error): .{1,60} on line \d+|warning: undefined (?:variable|index|array key)"),
    ("error", ("server", "gateway", "service", "site", "backend"), r"internal server error|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|(?<![a-z])(?:server|site|service|backend|website) (?:hit a problem|is (?:temporarily )?(?:down|unavailable|busy|overloaded|not responding|under maintenance)|encountered an|did not (?:respond|answer)|has gone away|can(?:no|')t be reached|could not (?:be reached|process|complete))"),
    ("error", ("page", "url", "link", "article", "file", "resource"), r"(?:page|url|link|article|file|resource|content)(?: that)?(?: you(?:'re| are| have)?(?: (?:requested|asked for|looking for|trying to (?:reach|access|view|open)|followed))?)?(?: here)?(?: (?:does|did|do|could|can) ?(?:not|n't)(?: be)? (?:exist|found|located|opened|displayed|available)| cannot be (?:found|displayed|opened)| (?:was|is) not (?:found|available)| is no longer available| no longer exists?| (?:has|have|may have) been (?:removed|moved|deleted))|page you (?:asked for|requested|are looking for)"),
    ("error", ("please", "try again", "back to the", "return to", "contact", "tell the"), r"(?:please )?try again (?:later|in a (?:few|moment|minute))|please (?:reload|refresh|retry|log ?in again|sign in again|wait and)|(?:please )?contact (?:the |your )?(?:site |system |web ?)?(?:admin|owner|master|support)|tell the site owner|(?:go|click) (?:here to go )?back to the (?:start|home|main) ?page|return to the home ?page"),
    ("error", ("denied", "expired", "too many", "refused", "timed out", "timeout", "time-out", "went wrong", "not found", "unauthor", "forbidden", "gone", "reset", "permission", "limit", "upstream", "bad request", "required", "allowed", "acceptable", "conflict", "too large", "internal", "implemented", "gateway", "unavailable", "server error", "closed", "have access"),
        rf"{_OPEN} ?(?:{_REASON}|access (?:is |to .{{1,30}} )?denied|session (?:has )?(?:expired|timed out)|request timed out|connection (?:was )?(?:refused|reset|timed out|closed)|rate limit exceeded)(?! (?:on|in|at|by|between|among|evidence|to the)(?![a-z]))(?:\W|$)|you (?:do not|don't) have (?:permission|access)|{_REASON} ?\(ref|something went wrong(?:\W|$)"),
    ("error", ("出错", "出了点", "出现", "发生"), r"出错了|出了点(?:小)?问题|(?:系统|服务器?|程序|页面)(?:出现|发生)(?:未知)?(?:错误|异常)"),
    ("error", ("错误码", "错误代码", "错误编号", "状态码"), r"(?:错误码|错误代码|错误编号|状态码)[::]? ?\w{0,6}\d"),
    ("error", ("登录", "登陆", "会话"), r"(?:登[录陆](?:状态|信息)?|会话)(?:已)?(?:失效|过期|超时)|请(?:您)?(?:先|重新)登[录陆](?:后|$|[!。,])"),
    ("error", ("稍后", "稍候", "刷新", "管理员", "首页", "跳转", "检查"), r"请?(?:您)?(?:稍后|稍候)(?:片刻)?(?:再试|重试|再来|再访问|刷新)|(?:^|[!。, ])(?:请)?点击刷新|请刷新(?:页面|后|重试)|(?:^|[!。, ])请(?:与)?联系(?:系统|网站)?管理员|返回(?:网站|题库|上一页|站点)?首页|秒后(?:自动)?跳转|请检查(?:您的)?网络"),
    ("error", tuple("页面 网页 内容 题目 试题 条目 链接 资源 文件 文章 帖子 视频 商品 网址 地址".split()), rf"(?:访问|请求|查看|打开|浏览|查找|寻找)的{_THING}(?:暂时)?(?:不存在|已(?:被)?(?:删除|移除|下架)|找不到|无法|未找到|走丢)|{_THING}(?:已经?(?:被)?(?:删除|下架|移除|失效|过期)(?:$|[。!,( ])|不存在(?:$|[。!,( ])|走丢了|找不到了|(?:加载|读取|打开)(?:出错|失败))|(?:^|[!。, ])找不到(?:该|此|您要的)?{_THING}"),
    ("error", ("加载", "读取", "连接"), r"(?:^|[!。,: ])(?:数据|图片|资源|服务器|网络|页面)?(?:加载|读取|连接)(?:出错|失败|超时)(?:$|[,。! (])"),
    ("error", ("权限", "频繁", "被拒绝"), r"(?:您|你|当前用户|账号)?(?:没有|暂无|无)(?:查看|访问|操作|浏览)(?:该|此|本)?(?:页面|内容|题目)?(?:的)?权限|访问(?:过于|太)频繁|访问被拒绝|请求(?:过于|太)频繁"),
    ("error", tuple("系统 服务 网络 接口 数据库 页面 网页 网站 站点 后台 程序 请求 连接 访问".split()), rf"(?:^|[!。,:( \"])(?:抱歉|对不起|您的|当前|提示)?,? ?{_PARTY}(?:当前|暂时|正在)?(?:繁忙|忙|异常|无响应|连接失败|错误|超时|维护|维护中|升级中|开小差|出错|不可用|中断|故障)(?:了)?(?:,?$|[。!(\"]| ?,? ?(?:请|错误|点击|返回|正在|暂时|稍|刷新|再试))"),
    ("filler", ("lorem", "ipsum"), r"(?<![a-z])lorem ipsum(?![a-z]).*|ipsum dolor"),
    ("filler", ("占位", "此处", "示例文字", "示例文本"), r"占位(?:文字|内容|文本|符).{0,8}(?:替换|删除|$|[。!])|此处(?:为|是)?(?:占位|示例|填充)(?:文字|内容|文本)|(?:^|[,。! ])(?:示例文字|示例文本)(?:$|[,。!])"),
    ("filler", ("placeholder", "coming", "available", "dummy", "sample text", "under construction", " yet", "provided"), r"placeholder text|dummy (?:text|content)|sample text(?: here|$)|(?:content|explanation|answer|page|article|section|detail|description|more)s? (?:is |are )?(?:coming|available) soon|^\W*coming soon\W*$|no (?:explanation|content|answer|text|description|detail)s? (?:is |are )?(?:available|yet|provided)|(?:page|site|section) (?:is )?under construction"),
    ("filler", ("建设中", "暂无", "尚未", "整理中", "待", "更新中", "编写中", "撰写中", "敬请期待", "记得补", "后补", "完善中"), r"(?:内容|页面|栏目|网站)(?:正在)?建设中|(?:^|[::。!, ])暂无(?:解析|答案)|(?:^|[::。!, ])暂无(?:相关)?(?:解析|内容|答案|题目|数据|简介|介绍|描述|信息)(?:$|[。!,])|尚未(?:录入|填写|添加|上传|编写)|(?:解析|内容|答案|题目|正文|本节|本页|本章|资料|说明|简介|介绍).{0,4}(?:整理中|待更新|待完善|待补充|更新中|编写中|撰写中|完善中)|敬请期待|(?:编辑|作者|编者):.{0,4}记得补|^\W*(?:略[。.]?)?后补\W*$"),
    ("filler", ("todo", "to do", "tbd", "tba", "tbc", "fixme", "asdf", "qwerty"), r"(?:^|[^a-z])to ?do ?: |^\W*(?:tbd|tba|tbc|fixme|todo)\W*$|(?<![a-z])(?:asdf){2,}|qwertyuiop"),
]
#: Repeated words and phrases need no string; they are asked of every line.
REPEATED = re.compile(rf"(?<![a-z])([a-z]{{2,8}})(?:[ ,.]+\1(?![a-z])){{3,}}|^([a-z]{{2,8}})(?: \2){{2,}}$|(?!(.)\3{{3}})([{_HAN}]{{2,12}})\4{{2,}}")
RUN = re.compile(r"^([^\W\d_])\1{5,}$")
# Words of the usual pseudo Latin.
_LATIN = frozenset(
    "ad aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure"
    " labore laboris laborum lorem magna minim modi mollis mollit nisi non nostrud nulla occaecat officia pariatur proident quem qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam vix voluptate".split()
)
# Function words, of which pseudo Latin has none.
_FUNCTION = frozenset("the of and to is was were are for with at on as by from not a an or it we our this that be but has have had which user assistant he she they his her their you your".split())
#: Sentences about such things: what a mark stands for, what was counted, what a program does.
TALK = re.compile(
    r"(?:template|placeholder|syntax|slot|模板|占位符|变量|语法).{0,60}(?:marks?|slot|denotes?|stands? for|means?|writes?|written|uses?|replaced|表示|代表|标记|替换|渲染|写作|写成)"
    r"|(?:marks?|denotes?|stands? for|represents?).{0,30}(?:slot|placeholder|template)"
    rf"|(?:{_NOTHING}|none|[45]\d\d|错误码|状态码|placeholder|占位|error).{{0,12}}(?:表示|代表|同义|等同|一词|是指|意为|means?(?![a-z])|denotes?|stands? for|indicates?)"
    r"|(?:一类|之类|这类|等)的?(?:填充|占位|假)(?:文字|文本|内容)|(?:filler|dummy) text such as|(?:若|如果|当|每当)(?:接口|服务器?|程序|网站|系统|请求).{0,6}(?:返回|报|出现)|(?:if|when(?:ever)?) the (?:server|service|api|site|page|program) (?:returns?|answers?|fails?|reports?|shows?|displays?)"
    r"|(?:answered|returned|said|says|reported|logged|called|titled|displayed|read) ?['\"]|(?:重试|retr(?:y|ied)).{0,8}\d+ ?(?:次|times)|(?:用|使用|采用|基于|以) ?(?:java ?script|js)(?![a-z]).{0,6}(?:编写|计时|实现|开发|渲染|绘制)"
)
#: Sentences that report how often an error or notice came.
COUNTED = re.compile(r"(?<![\d.])\d+ (?:times|attempts|requests|occasions)(?![a-z])|(?:共|重试|出现了?|发生了?|返回了?) ?\d+ ?次|\d+ ?次(?:错误|报错|失败|重试)")
_SPLIT = re.compile(rf"(?<=[。!?;])|(?<=[a-z)'\d>}}\]]\.)(?= |[{_HAN}]|$)")
_LINES = re.compile(r"[\n\r\x0b\x0c\x85  ]+")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_BLANKS = re.compile(" {2,}")
_WORD = re.compile(r"[^\W\d_]+")
_COMPILED = [(kind, re.compile(pattern)) for kind, _, pattern in RULES]
_BY_STRING: dict[str, list[int]] = {}
for _i, (_, _strings, _) in enumerate(RULES):
    for _s in _strings:
        _BY_STRING.setdefault(_s, []).append(_i)
_FOLD = _Table(lambda c: fold_char(c).lower())


def folded(line: str) -> str:
    """Lower case, one width, one look, one kind of blank, no invisible characters."""
    t = line.translate(_FOLD)
    return (_BLANKS.sub(" ", t) if "  " in t else t).strip()


def lines(text: str) -> list[str]:
    """The folded lines of a text that show anything."""
    if text.lstrip()[:1] in ("{", "["):  # line ends of a text that is written as JSON
        text = text.replace("\\n", "\n")
    return [x for x in map(folded, _LINES.split(text)) if x]


def line_key(line: str) -> int:
    """A line with its numbers made equal, as a 64-bit number."""
    return int.from_bytes(hashlib.blake2b(_NUMBER.sub("0", line).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def sentences(line: str) -> list[str]:
    """Pieces of a line that end with a sentence; a Latin full stop ends one before a blank or a Han character."""
    return [x for x in (s.strip() for s in _SPLIT.split(line)) if x]


def pseudo_latin(sentence: str) -> bool:
    """Five words or more without a function word, of which three, or two and a fifth of all, are of the usual pseudo Latin;
    or eight or more, one of them of it, of which a quarter are repetitions."""
    words = _WORD.findall(sentence)
    if len(words) < 5 or any(w in _FUNCTION for w in words):
        return False
    known = [w for w in words if w in _LATIN]
    if len(set(known)) >= 3 and len(known) * 8 >= len(words) or len(set(known)) >= 2 and len(known) * 5 >= len(words):
        return True
    return len(words) >= 8 and bool(known) and len(set(words)) * 4 <= len(words) * 3


def evidence(line: str) -> str | None:
    """The first kind of residue that a sentence of a folded line shows, in the order of KINDS."""
    maybe = sorted({i for s, rules in _BY_STRING.items() if s in line for i in rules})
    again = REPEATED.search(line) is not None
    latin = " " in line and pseudo_latin_line(line)
    if not (maybe or again or latin):
        return None
    found = set()
    for x in sentences(line):
        hit = {_COMPILED[i][0] for i in maybe if _COMPILED[i][1].search(x)}
        if again and REPEATED.search(x) or latin and pseudo_latin(x):
            hit.add("filler")
        if hit and not TALK.search(x):
            found |= hit - {"error", "script_required"} if COUNTED.search(x) else hit
    return next((k for k in KINDS if k in found), None)


def pseudo_latin_line(line: str) -> bool:
    """Whether a sentence of the line can be pseudo Latin."""
    return not _LATIN.isdisjoint(_WORD.findall(line))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc, host, lines: array of key, kind, run) of every document with text, in one pass."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, ends, keys, kinds, runs = [], [0], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                own = lines(t) if t else []
                if own:
                    keep.append(i)
                    keys += map(line_key, own)
                    kinds += map(evidence, own)
                    runs += [RUN.match(x) is not None for x in own]
                    ends.append(len(keys))
            # null kinds compress to nothing
            each = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(runs, pa.bool_())], names=["key", "kind", "run"])
            some = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("doc"), some.column("host"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["doc", "host", "lines"])

    return docs.mapInArrow(run, f"doc {kind}, host string, lines array<struct<key:long,kind:string,run:boolean>>")


def recurrent_lines(marked: DataFrame, least_docs: int, least_share: float) -> DataFrame:
    """(host, key) of the lines that recur in a host. Counts combine on the map side, so a large host is no hot task.

    A host has at most its mean number of lines a document divided by the share of them, whatever its size.
    """
    n = marked.groupBy("host").agg(F.count_distinct("doc").alias("n_docs"))
    each = marked.select("host", "doc", F.explode(F.array_distinct("lines.key")).alias("key")).distinct()
    counts = each.groupBy("host", "key").agg(F.count("*").alias("k")).filter(F.col("k") >= least_docs)
    return counts.join(n, "host").filter(F.col("k") >= F.col("n_docs") * least_share).select("host", "key")


def residue_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc, kinds) of the documents that show residue, with the kinds of evidence.

    A line is evidence or not whatever the other lines are, so each is asked in the pass that makes its key, and texts are
    read once. Then lines are counted and the recurrent ones subtracted; only lines of documents that have evidence at all, or a
    run of one letter, go through that join.
    """
    own = docs.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-")).alias("host"), F.col(text).alias("text"))
    marked = materialize(_marked(own), "lines")
    common = recurrent_lines(marked, least_docs, least_share).withColumn("common", F.lit(True))
    maybe = marked.filter(F.exists("lines", lambda x: x["kind"].isNotNull() | x["run"]))
    each = maybe.select("doc", "host", F.explode("lines").alias("l")).select("doc", "host", "l.*").join(common, ["host", "key"], "left")
    own, rest = F.col("common").isNull(), F.count_if(F.col("common").isNull())
    g = each.groupBy("doc", "host").agg(
        rest.alias("rest"), F.collect_set(F.when(own, F.col("kind"))).alias("left"), F.collect_set("kind").alias("whole"),
        F.bool_and(F.when(own, F.col("run"))).alias("only_run"), F.bool_and("run").alias("all_run"),
    )
    kinds = F.when(F.col("rest") == 0, F.col("whole")).otherwise(F.col("left"))
    runs = F.when(F.when(F.col("rest") == 0, F.col("all_run")).otherwise(F.col("only_run")), F.array(F.lit("filler"))).otherwise(F.array().cast("array<string>"))
    found = g.select("doc", F.array_union(kinds, runs).alias("kinds")).filter(F.size("kinds") > 0)
    return found.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")).withColumnRenamed("doc", doc)
