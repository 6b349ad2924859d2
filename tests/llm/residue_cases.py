"""Sentences written for measuring problem 9, apart from those that its patterns were written from.

None of them was used while the patterns were written; what they show is in the README.
"""

HELD_RESIDUE = [
    "Hi {{ customer.first_name }}, thanks for your order!", "Welcome back, <%= current_user.email %>", "{% if user.is_active %}Your plan{% endif %} renews soon.", "Dear ${recipient.name}, your appointment is confirmed.",
    "尊敬的{{客户姓名}}，您的报告已生成。", "患者[姓名]，[年龄]岁，因[主诉内容]入院。", "报告日期：{report_date}", "Dear [NAME], we are writing to inform you of the results.", "Please contact [COMPANY] for further information.",
    "Author: [Your name here]", "本次检查由【请填写科室】完成。", "Total: $NaN", "Patient age: undefined", "Hello null, your results are ready.", "[object Object]", "收件人：undefined", "The value is %d of %d.", "Sent to %(email)s on file.",
    "__title__ is shown here", "剂量为@@dose@@每日两次。", "#REF!", "Result: <insert value here>", "[INSERT ABSTRACT HERE]", "{{title", "第{0}章 共{1}页",
    "404 Not Found", "Error 503: Service Unavailable", "HTTP 500 - Internal Server Error", "The requested URL was not found on this server.", "Sorry, the page you are looking for does not exist.", "Access denied. You don't have permission to view this resource.",
    "Oops! Something went wrong. Please try again later.", "Your session has expired. Please log in again.", "This site can't be reached", "TypeError: Cannot read properties of undefined (reading 'map')", "java.lang.NullPointerException: value",
    "Traceback (most recent call last):", "抱歉，您要访问的页面不存在", "服务器内部错误，请稍后重试", "系统维护中，请稍后再试。", "对不起，该文章已被删除。", "网络连接超时，请检查您的网络设置", "您没有权限访问该页面", "会话已过期，请重新登录", "Too Many Requests",
    "Error establishing a database connection", "502 Bad Gateway nginx", '{"status": "error", "message": "invalid token"}', "Warning: mysqli_connect(): access denied in /var/www/db.php on line 12",
    "Please enable JavaScript to continue using this application.", "You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser.", "This page requires JavaScript. Please turn it on.", "请开启浏览器的JavaScript后继续浏览", "您的浏览器不支持JavaScript，部分内容无法显示", "本站需要启用脚本才能正常显示",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem", "Duis aute irure dolor in reprehenderit in voluptate velit", "This is placeholder text.", "Coming soon", "内容正在建设中，敬请期待", "暂无内容", "本节内容待补充", "TODO: write the discussion section",
    "blah blah blah blah blah", "测试文字测试文字测试文字测试文字", "TBD", "asdfasdfasdf", "No description available.", "此处为示例文字，请替换。",
]
HELD_CONTENT = [
    "We failed to reject the null hypothesis at the 5% level.", "The undefined term in this proof is taken from the second chapter.", "患者网络错误，改用电话随访。", "Null mutations of this gene cause early loss of vision.", "Division by zero is undefined.", "The sample was stored in a 404 mm tube for 500 days.",
    "Of 503 patients, 12 were lost to follow-up.", "Medication errors occurred in 4% of admissions.", "The standard error: 0.34 for the first arm and 0.29 for the second.", "Refractive error is the most common cause of poor sight in children.", "An error in the dose was found by the pharmacist before the drug was given.",
    "Access to care was denied to some patients for lack of insurance.", "The server brought the dishes to the table without delay.", "No metastases were found in the liver or lungs.", "Bone marrow was not available for examination in two cases.", "The patient was asked to try again with the other hand.",
    "Java is an island with many volcanoes.", "She wrote the script for the film in three weeks.", "The nurse read the script aloud to each caller.", "Scripts for opioids fell by a fifth after the new rule.", "Our web application is written in JavaScript and runs in any browser.", "该系统前端使用JavaScript编写，后端使用Java。", "剧本中男主角在第三幕才出场。",
    "数据库中共纳入3217例患者的随访资料。", "系统性红斑狼疮患者应避免日晒。", "服务器机房温度应保持在22℃左右。", "网络问卷共发放500份，回收487份。", "患者否认药物过敏史，既往体健。", "该药的错误使用可导致肝损伤。", "下列说法错误的是", "题目要求选择最佳答案。", "连接性组织病变多见于老年女性。", "脚本护理可提高新护士的应急能力。", "超时未归者应及时联系家属。", "请患者稍后再次测量血压。",
    "集合{1,2,3}的子集共有8个。", "f(x) = {x^2, x > 0}", "See Figure 3 [12] and Table 2 [13-15].", "The genotype was [A/G] in 12 carriers.", "The interval [0, 1] is closed.", "Use <b>bold</b> for drug names.", "p < 0.05 and r > 0.3 were taken as significant.", "参考值<5%，>10%为异常。", "成绩 = 平时分 × 30% + 考试分 × 70%", "The price rose from $5 to $8 per box.",
    "Write your answer in the space ______ below.", "血清钾正常值为____mmol/L。", "（　　）是冠心病最常见的病因。", "In our template, {{name}} stands for the patient's name.", "模板中的{{姓名}}会在打印时替换为患者姓名。", "A 404 status code means that the page was not found.", "状态码500表示服务器内部错误。", "Designers use filler text such as lorem ipsum to fill a page before the copy is written.",
    "The dolor of the joint, with rubor and calor, is a sign of inflammation.", "Chronic renal failure, arterial hypertension, diabetes mellitus, bronchial asthma", "Homo sapiens neanderthalensis lived in Europe.", "哈哈哈，这道题太简单了。", "慢慢慢慢地推注，避免药液外渗。", "Very very good tolerance was seen.", "ATG ATG ATG codons start translation.", "No answer was given by nine of the respondents.", "The results will be available soon after the trial ends in June.",
    "补液待血容量补足后再行手术。", "待查体结果出来后再定方案。", "护士应尚未出现症状时即开始干预。", "本病暂无特效治疗方法。", "目前暂无数据支持该用法在孕妇中的安全性。", "Dr. Nan examined the patient on Monday.", "Nan and Bob went home.", "None of the patients died.", "None declared.", "Conflict of interest: none.", "Gateway hypothesis of drug use is disputed.", "Connection between diet and gout is well known.", "Forbidden foods include raw fish and soft cheese.", "The session lasted 40 minutes.",
    "He contacted the administrator of the hospital about the bill.", "Please refresh your memory with chapter four.", "Gone are the days when bed rest was advised.", "The unavailable data were imputed.", "We encountered an error of 2% between the two scales.", "患者访问专家门诊的频率为每月一次。",
]
