import pytest

from examloom.llm import residue
from examloom.llm.residue import evidence, lines, residue_documents
from residue_cases import HELD_CONTENT, HELD_RESIDUE

RESIDUE = [
    ("placeholder", "患者{{{user_name}}}，因[考试名称待填]入院"), ("placeholder", "亲爱的【请填写题干】同学"), ("placeholder", "Question: ${option_a}"), ("placeholder", "Answer: undefined"),
    ("placeholder", "根据<%= ｏｐｔｉｏｎ_ａ %>，可排除__ｓｔｅｍ__"), ("placeholder", "患者#REF!，因[object Object]入院"), ("placeholder", "Run {0} kept {0} rows"), ("placeholder", "影像学提示直径约××解析内容××cm"), ("placeholder", "Hello $1!"), ("placeholder", "Explanation of %(score)s: %d"),
    ("script_required", "Please enable JavaScript to view this question."), ("script_required", "YOUR BROWSER BLOCKS JS; TO VIEW THIS QUESTION, ALLOW IT FIRST."), ("script_required", "检测到浏览器脚本被拦截，暂不能查看题目D. 辛特贝型关节炎"), ("script_required", "本页面需要JS支持，请开启后刷新再继续答题。"), ("script_required", "请允许运行页面脚本并接受 Cookie，然后加载选项"),
    ("error", "HTTP ERROR 403The server hit a problem"), ("error", "出错了！登录状态失效，错误码：４１０，返回题库首页"), ("error", "ValueError: 'title'"), ("error", "Traceback (most recent call last):"), ("error", "503 PAGE GONE"), ("error", '{"error": {"code": 403, "message": "request timeout"}}'), ("error", "ERROR 1225 (HY061): cannot reach the item store"), ("error", "HTTP ЕRRОR 403"),
    ("filler", "Lorem ipsum dolor sit amet orema fructa"), ("filler", "占位内容占位内容占位内容"), ("filler", "test test test test test"), ("filler", "暂无解析"), ("filler", "TBD"), ("filler", "trist nulla perat mollis ambit dria ulpa sit"),
]
CONTENT = [
    "提示词模板用 {hint} 表示题干所在位置，渲染时由程序替换，替换后再计算编号。", "The prompt template marks the options slot as {{question}}; our loader fills it before training.", "统计显示 lorem ipsum 一类的填充文字在旧题库中占0.8%。", "题库网站前端用 JavaScript 计时，63分钟后自动交卷。",
    "化验单上 NaN 表示未做该项，null 与空白同义。", "若接口返回 500，标注程序会等待37秒后重试，本轮共重试239次。", "访谈脚本要求护士先询问口干，再启用尼来丁方案。", "正常成人血脂的参考值为____，CoPA-1升高见于（　　）。", "待补充血容量后再测MKB，此处插入导管时注意瘙痒。", "未找到视网膜边界不清的肿块，页面右侧附图可见舌根轮廓。",
    "集合 {A, C} 与 {B} 的交为空时记零分。", "<1.1mmol/L> 为正常，[4, 49] 为可信区间，$35/盒。", "The annotation service answered 'Too Many Requests' 79 times, so we lowered the rate to 9 per second.", "A dose of 404 mg every 8 hours was tolerated by 249 patients.", "列乐每日500mg，未见 error 提示的输液泵报警。", "<p>选项：</p>", "<|im_start|>user", "某项，错误。", "共纳入404例新入职护士。",
]


def _kind(text):
    return next((k for k in map(evidence, lines(text)) if k), None)


def test_residue_is_found():
    assert [(_kind(t), t) for _, t in RESIDUE] == RESIDUE


#: Sentences without any word but the ones of their own pattern.
BARE = [
    ("error", "系统错误。"), ("error", "服务器错误。"), ("error", "网络错误。"), ("error", "数据库错误。"), ("error", "页面错误。"), ("error", "您请求的页面不存在。"), ("error", "请求的网页找不到"), ("error", "题目读取失败"),
    ("filler", "编辑:记得补图。"), ("filler", "作者：记得补"), ("filler", "答案待补充"), ("filler", "ab ab ab"), ("placeholder", "结果：None"), ("script_required", "脚本已禁用"),
]


def test_bare_residue_is_found(spark):
    assert [(_kind(t), t) for _, t in BARE] == BARE
    rows = [(i, f"下列说法正确的是\n{t}", "notes") for i, (_, t) in enumerate(BARE)]
    assert {r.doc_id: r.kinds for r in residue_documents(_docs(spark, rows)).collect()} == {i: [k] for i, (k, _) in enumerate(BARE)}


def test_talk_and_content_are_not():
    assert [t for t in CONTENT if _kind(t)] == []


def test_held_out_sentences():
    hit, false = sum(_kind(t) is not None for t in HELD_RESIDUE), sum(_kind(t) is not None for t in HELD_CONTENT)
    assert hit >= 0.9 * len(HELD_RESIDUE) and hit >= 0.9 * (hit + false)


@pytest.mark.parametrize("text", [*(t for _, t in RESIDUE + BARE), *HELD_RESIDUE])
def test_strings_of_a_rule_are_in_whatever_it_matches(text):
    for line in lines(text):
        for (_, strings, _), (_, pattern) in zip(residue.RULES, residue._COMPILED, strict=True):
            if pattern.search(line):
                assert any(x in line for x in strings), (pattern.pattern, line)


SCHEMA = "doc_id long, text string, source string, doc string, keys int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA)


def test_documents_and_boilerplate(spark):
    nav = "首页 > 题库 > 第{}章\n{}\n上一题 | 下一题 | 收藏"
    rows = [(i, nav.format(i, f"第{i}种药物可上调血压。"), "notes") for i in range(30)]
    rows += [(100, nav.format(9, "啊" * 12), "notes"), (101, "解析：内容" + "啊" * 60, "notes"), (102, "好好好\n" + "x" * 90, "notes"), (103, "上文\n出错了！请求超时\n下文", None), (104, None, "notes"), (105, "", "notes"), (106, " \n\r\n　", None), (107, "a" * 300_000 + "\n请启用JS后提交答案", "notes"), (108, "TBD", None), (108, "TBD", None)]
    got = {r.doc_id: r.kinds for r in residue_documents(_docs(spark, rows)).collect()}
    assert got == {100: ["filler"], 103: ["error"], 107: ["script_required"], 108: ["filler"]}


FOOTER = "Please enable JavaScript"


def test_footer_takes_no_page_with_content_away(spark):
    rows = [(i, f"第{i}种药物可上调血压，见{'甲乙丙丁戊己庚辛壬癸'[i % 10]}{'子丑寅卯辰'[i % 5]}章第{i // 10}节。\n{FOOTER}", "notes") for i in range(200)]
    rows = [(i, t.replace("第", "第" + chr(0x4E00 + i), 1), h) for i, t, h in rows]
    bad = [(300, f"出错了！请求超时\n{FOOTER}", "notes"), (301, f"TBD\n{FOOTER}", "notes")]
    whole = [(310, FOOTER, "notes")]
    got = {r.doc_id: r.kinds for r in residue_documents(_docs(spark, rows + bad + whole)).collect()}
    assert got == {300: ["error"], 301: ["filler"], 310: ["script_required"]}
    # without subtraction every page would go
    assert residue_documents(_docs(spark, rows + bad + whole), least_docs=10**9).count() == 203
    # nor where the share asked for is not reached
    assert residue_documents(_docs(spark, rows + bad + whole), least_share=1.01).count() == 203


def test_repeated_documents(spark):
    same = [(i, "某药可上调血压。\n次日复查。", "glossary") for i in range(20)]
    page = [(100 + i, "出错了！请求超时\n返回首页", "web") for i in range(20)]
    got = {r.doc_id: r.kinds for r in residue_documents(_docs(spark, same + page)).collect()}
    assert got == {100 + i: ["error"] for i in range(20)}


def test_one_host_with_most_lines_stays_whole(spark):
    rows = [(i, f"{chr(0x4E00 + i % 5000)}{chr(0x5E00 + i // 7 % 900)}药可上调血压。\n{FOOTER}" + ("\n暂无解析" if i == 17 else ""), "hot" if i % 3 else f"h{i}") for i in range(3000)]
    got = {r.doc_id for r in residue_documents(_docs(spark, rows)).collect()}
    assert got == {i for i in range(3000) if i % 3 == 0} | {17}


def test_empty_table(spark):
    assert residue_documents(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["x\x0b{{stem}}", "《{{stem}}》", "（待补充：答案）", "{ stem }" * 0 + "@@BODY@@"])
def test_placeholder_forms(spark, text):
    assert residue_documents(_docs(spark, [(1, text, "s")])).count() == 1
