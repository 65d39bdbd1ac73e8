"""The kinds of findings: group, title in two languages, and whether one of weight changes a conclusion."""

from __future__ import annotations

SEVERITIES = ("critical", "major", "minor")

# Groups in the order of a report.
GROUPS = {
    "numbers": ("Numbers", "数字"), "statistics": ("Statistics", "统计"), "references": ("References", "参考文献"), "figures": ("Figures and tables", "图表"),
    "code": ("Code and data", "代码和数据"), "reporting": ("Reporting standards", "报告规范"), "claims": ("Claims", "结论"), "writing": ("Writing", "写作"), "other": ("Other", "其他"),
}

# Category, its group, and whether it changes a conclusion; titles are this engine's own.
CATEGORIES = {
    "prose_table_number_disagreement": ("numbers", "Text differs from table", "正文与表格不符", True),
    "cross_section_number_disagreement": ("numbers", "One metric with several values", "同一指标多个数值", True),
    "relative_change_mismatch": ("numbers", "Change does not follow from its pair", "变化率与两数不符", True),
    "same_change_different_values": ("numbers", "One change with two values", "同一变化两个数值", True),
    "percent_count_mismatch": ("numbers", "Percentage differs from its count", "百分比与计数不符", True),
    "percent_denominator_outlier": ("numbers", "A percentage with another denominator", "百分比分母不一致", False),
    "product_total_mismatch": ("numbers", "Factors do not multiply to the total", "乘积与总数不符", True),
    "compute_budget_inconsistency": ("numbers", "Budget does not follow from its parts", "总量与分项不符", True),
    "terminal_digit_nonuniform": ("numbers", "Uneven last digits", "末位数字分布异常", False),
    "pvalue_recompute_mismatch": ("statistics", "p does not follow from its statistic", "p 值与统计量不符", True),
    "pvalue_z_mismatch": ("statistics", "p does not follow from z", "p 值与 z 值不符", True),
    "pvalue_t_impossible": ("statistics", "p too small for t", "t 值不能得出该 p 值", True),
    "pvalue_clustering_below_0_05": ("statistics", "p values crowd below 0.05", "p 值集中在 0.05 以下", False),
    "interval_p_contradiction": ("statistics", "Interval and p disagree", "区间与 p 值矛盾", True),
    "estimate_outside_interval": ("statistics", "Estimate outside its interval", "估计值在区间之外", True),
    "effect_size_mismatch": ("statistics", "Effect size does not follow from F", "效应量与检验不符", False),
    "grim_infeasible_mean": ("statistics", "Mean that N integers cannot have (GRIM)", "均值不可能（GRIM）", True),
    "grimmer_infeasible_sd": ("statistics", "Deviation that N integers cannot have (GRIMMER)", "标准差不可能（GRIMMER）", True),
    "directional_claim_against_interval": ("claims", "Claim beyond its interval", "结论超出区间", True),
    "panel_reference_beyond_caption": ("figures", "Panel that the figure lacks", "引用不存在的子图", False),
    "uncited_float": ("figures", "Figure or table never referred to", "图表未被引用", False),
    "citation_undefined": ("references", "Citation without an entry", "引用无条目", False),
    "citation_beyond_list": ("references", "Citation beyond the list", "引用超出列表", False),
    "reference_never_cited": ("references", "Entry never cited", "条目未被引用", False),
    "reference_duplicate": ("references", "Work listed twice", "重复条目", False),
    "reference_not_found": ("references", "Work that no registry knows", "查无此文献", True),
    "reference_doi_unresolved": ("references", "DOI that does not resolve", "DOI 无法解析", False),
    "reference_doi_mismatch": ("references", "DOI of another work", "DOI 属于其他文献", False),
    "reference_arxiv_unresolved": ("references", "arXiv identifier that does not exist", "arXiv 编号不存在", False),
    "reference_arxiv_mismatch": ("references", "arXiv identifier of another work", "arXiv 编号属于其他文献", False),
    "reference_retracted": ("references", "Retracted work", "已撤稿文献", True),
    "reference_concern": ("references", "Work with an expression of concern", "有关注声明的文献", False),
    "reference_year_mismatch": ("references", "Year differs from the record", "年份与记录不符", False),
    "constructed_series_json": ("code", "Results that step by a constant", "结果等差排列", True),
    "back_solved_mean": ("code", "Runs that average onto the rounding", "均值恰为舍入值", True),
    "label_derived_score": ("code", "Score solved for from the labels", "由标签反推的分数", True),
    "unbound_released_record": ("code", "Result that no test reads", "无测试读取的结果", False),
    "assistant_residue": ("writing", "Chat text or placeholder", "对话残留或占位符", False),
    "tortured_phrase": ("writing", "Swapped synonyms of a term", "术语被同义替换", False),
    "abbreviation_before_definition": ("writing", "Abbreviation before its definition", "缩写先用后定义", False),
    "abbreviation_two_expansions": ("writing", "Abbreviation with two expansions", "缩写有两种全称", False),
}

LABELS = {
    "en": {"title": "Check report", "first": "change a conclusion", "major": "worth correcting", "minor": "minor", "gaps": "not verified", "where": "Where", "quote": "Passage", "evidence": "Evidence", "calculation": "Calculation", "fix": "Correction", "statements": "Declarations", "summary": "Review", "guideline": "Guideline", "dismissed": "Dismissed", "references": "References", "context": "Context", "yes": "yes", "no": "no"},
    "zh": {"title": "核查报告", "first": "影响结论", "major": "值得更正", "minor": "次要", "gaps": "未核实", "where": "位置", "quote": "原文", "evidence": "依据", "calculation": "计算", "fix": "更正", "statements": "声明", "summary": "评审", "guideline": "规范", "dismissed": "已排除", "references": "参考文献", "context": "上下文", "yes": "有", "no": "无"},
}
