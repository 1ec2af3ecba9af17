"""Patterns by which questions are classified. They have to equal those of other systems that share the rules.

Questions are in Chinese or English; patterns apply to lower-cased, trimmed text.
"""

# Whole questions that are greetings, after the marks that may end them.
GREETINGS = ("你好", "hello", "hi", "早上好", "下午好", "晚上好", "最近怎样", "在吗", "嗨", "您好")
END_MARKS = r"[！!。.?？ ]+$"

# What asks for evidence. The first two and the last apply to the instruction, POLICY to the whole question.
RETRIEVAL = r"(?:根据|结合|依据|检索|查阅|查找|查询|查一下|读取|从).{0,32}(?:知识库|项目资料|实验记录|内部论文|论文|文献|资料|报告|记录|规范)"
PROVIDED_MATERIAL = r"(?:根据|结合|依据|使用|从)\s*(?:下面|以下|这段|上述|我提供的|给定的|粘贴的)"
SEARCH_VERBS = r"检索|查找|查阅|查询|查一下|读取"
POLICY = r"有.{0,5}证据|(?:实验室|项目|评测).{0,12}(?:规范|制度|要求|规定|流程)|(?:规范|制度).{0,8}(?:要求|是什么)"
ACTIONS = (
    r"计算|算出|求(?:平均|均值|中位数|标准差|和)|统计|汇总|换算|转换|估算|比较|对比|生成|整理|制作|"
    r"润色|改写|翻译|压缩|提取|检查|核对|拟定|设计|回复|回应"
)

# Going on with what was done before, and the user's own history.
CONTINUE = r"^(?:请)?(?:继续|再试一次|换成英文|再润色一下)[。！!？? ]*$"
PERSONAL_HISTORY = r"我(?:之前|刚才|上次).{0,12}(?:关注|偏好|提到|说过|问过|讨论过|研究)|(?:还记得|记不记得).{0,8}我"

# Instructions about writing, and the tools that these take.
WRITING = (
    r"(?:生成|拟定|设计|列出|写|拟).{0,16}(?:论文提纲|论文大纲|论文摘要|审稿回复|rebuttal)|"
    r"(?:润色|改写|压缩|翻译).{0,20}(?:论文|摘要|学术|段落|英文|中文|abstract)|"
    r"(?:论文|摘要|学术|段落|abstract).{0,12}(?:润色|改写|压缩|翻译)|"
    r"(?:整理|生成|制作|写).{0,16}(?:实验结果表|实验表格|实验结果段落)|"
    r"(?:回复|回应).{0,8}审稿意见|改得.{0,8}学术|"
    r"(?:检查|核对).{0,12}(?:润色|改写).{0,12}(?:数字|数值|引用|一致性)"
)
WRITING_TOOLS = ("paper_writing", "text_analysis", "citation_check")

# Instructions that ask for a tool.
TOOLS = {
    "datetime": r"现在几点|几点钟|当前时间|今天星期几|几点了|今天几号",
    "data_analysis": r"(?:分析|检查|统计|汇总|分组).{0,16}csv|csv.{0,16}(?:分析|检查|统计|汇总|分组)",
    "unit_conversion": (
        r"单位换算|换算单位|(?:估算|计算).{0,12}(?:传输时间|传输耗时)|"
        r"(?:换算|转换).{0,20}(?:mib|gib|mb|gb|gbps|mbps|毫秒|微秒|字节)|"
        r"\d\s*(?:gib|mib|gb|mb|ms|us|gbps|mbps).{0,12}(?:等于|相当于|换算|转成|转为)"
    ),
    "text_analysis": r"(?:对比|比较).{0,12}(?:两段文本|文本版本|文本差异)|(?:提取|检查).{0,12}(?:markdown.{0,4}标题|标题大纲)",
    "citation_check": r"(?:提取|检查).{0,12}(?:doi|arxiv)|(?:检查|校验|审查).{0,12}(?:引用编号|引用标记)",
    "rag_evaluation": r"(?:计算|评估).{0,12}(?:检索指标|recall@|precision@|ndcg@|rr@)|(?:预览|模拟).{0,12}(?:分块|切块|chunk)",
    "statistics": (
        r"(?:计算|求|统计|分析).{0,16}(?:均值|平均值|平均|中位数|标准差|方差)|"
        r"(?:比较|对比).{0,20}(?:指标|结果|recall|准确率|延迟|吞吐|f1|mrr|ndcg)|"
        r"指标对比|实验结果对比|基线对比|相对提升|百分比变化|(?:计算|算出).{0,16}(?:提升率|提升幅度|降幅)"
    ),
    "calculator": r"计算器|算术|\d+(?:\.\d+)?\s*(?:[+\-*/×÷%^]|乘以|除以|加上|减去)\s*\d+(?:\.\d+)?",
}

# Signals of questions that bring several sources together.
SIGNALS = {
    "cross_scope": (
        r"跨(?:多个)?(项目|方向|研究方向|论文|实验)|多个(项目|研究方向|论文|实验记录|组会纪要)|"
        r"不同(项目|研究方向|论文|实验|阶段)|分别.{0,12}(项目|方向|论文)"
    ),
    "several_sources": (
        r"论文.{0,12}(实验记录|组会纪要)|实验记录.{0,12}(论文|组会纪要)|"
        r"组会纪要.{0,12}(论文|实验记录)|多份(资料|证据|文档)"
    ),
    "synthesis": (
        r"综合(分析|比较|判断)|基于(证据|资料).{0,16}(建议|下一步|路线)|"
        r"研究建议|下一步研究|技术路线|形成.{0,8}建议"
    ),
    "change": r"时间演化|演变|最近.{0,8}(变化|进展)|新旧",
    "change_or_conflict": (
        r"时间演化|演变|最近.{0,8}(变化|进展)|新旧.{0,8}(冲突|差异)|"
        r"冲突|矛盾|错误前提|是否成立|验证.{0,8}前提"
    ),
    "conflict": r"冲突|矛盾|错误前提|是否成立|验证.{0,8}前提",
    "compare": r"对比|比较|差异|异同",
    "joining": r"综合|结合|基于|跨",
    "outcome": r"分析|比较|建议|验证|设计|形成|排查|清单|里程碑|假设",
    "verify": r"验证",
    "list": r"、",
}
SOURCE_KINDS = ("论文", "项目", "实验记录", "组会", "纪要", "规范", "集群", "制度", "研究计划", "设备预约")
LEAST_COMPLEX = 18

# What asks whether a premise holds (white space removed), and words of absolute claims.
PREMISE = (
    r"验证|核验|这一前提|该前提|前提是否",
    r"是否(?:已经|已)?(?:成立|属实|正确|得到证实|可以认为)",
    r"(?:能否|可否)认为|(?:是否可以|能否|可否)确认",
    r"判断.{0,24}(?:所有|全部|任何|每次|每个|必然|始终|从不).{0,24}(?:是否|都|必须|无需)",
)
ABSOLUTE = r"所有|全部|任何|每次|每个|完全相同|都无需|必然|始终|从不"

# Kinds of a reviewer's issue.
ISSUE_TYPES = ("none", "unsupported", "invalid_source", "false_premise", "conflict", "acl", "missing_evidence", "citation_gap")
