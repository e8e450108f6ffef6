"""Schemas and fixed vocabularies."""

from __future__ import annotations

KO = (
    "struct<type:string,summary:string,state:string,entities:array<struct<name:string,label:string>>,"
    "relations:array<struct<subject:string,predicate:string,object:string,status:string>>,tags:array<string>,importance:double,"
    "event_time:struct<start:string,end:string,expression:string,precision:string>,valid_time:struct<start:string,end:string,end_type:string>>"
)
SCENARIO = KO[:-1] + ",title:string>"
PERSONA = "struct<type:string,summary:string,state:string,importance:double>"
MEMORIES = (
    "pid string, layer string, collection string, memory_type string, point_type string, parent_pid string, summary string, title string, scenario_id string, "
    "state string, importance double, entities array<string>, tags array<string>, relations array<struct<subject:string,predicate:string,object:string,status:string>>, "
    "linked_l1_pids array<string>, evidence string, source string, event_time struct<start:string,end:string,expression:string,precision:string>, "
    "valid_time struct<start:string,end:string,end_type:string>, ts timestamp, recorded_at timestamp, source_time timestamp, embedding array<float>"
)

# Predicates that edges may have.
PREDICATES = [
    "KNOWS", "FRIEND_OF", "PARENT_OF", "CHILD_OF", "SIBLING_OF", "LOVES", "LIKES", "DISLIKES", "HATES", "RESPECTS",
    "ATE", "DRANK", "COOKED", "PLAYED_WITH", "WATCHED", "LISTENED_TO", "READ", "VISITED", "VISITED_WITH", "WALKED_WITH", "RODE",
    "SHOPPED_WITH", "ATE_WITH", "CELEBRATED", "COMFORTED", "ENCOURAGED", "ARGUED_WITH", "APOLOGIZED_TO", "MISSES",
    "TEACHES", "LEARNS_FROM", "WORKS_AT", "MANAGES", "COLLABORATES_WITH", "STUDIED", "PRACTICED", "COACHED",
    "OWNS", "HAS_GOAL", "HAS_HABIT", "HAS_PREFERENCE", "HAS_EXPERIENCE", "BELIEVES", "REMEMBERS",
    "HAPPENED_ON", "HAPPENED_IN", "HAPPENED_DURING", "MENTIONED_IN",
]
FALLBACK_PREDICATE = "MENTIONED_IN"
# Labels that nodes may have.
LABELS = ["Person", "Place", "Organization", "Animal", "Concept", "Object", "Event", "Goal", "Routine", "State", "Decision"]
FALLBACK_LABEL = "Concept"
# Replies that never deserve a recall.
FILLERS = [
    "嗯", "啊", "哦", "嗯嗯", "啊啊", "哦哦", "噢", "喔", "嗳", "好", "好的", "好哒", "行", "可以", "ok", "OK", "Ok", "okay", "OKAY",
    "继续", "再来", "搞起", "嗯好", "好哦", "看看", "y", "n", "no", "yes", "yeah", "yep", "nope", "ok呀", "ok啊", "好呀", "好啦",
    "对", "对的", "是的", "是的呢", "没错", "确实", "跑", "跑一下", "继续跑", "再来一次", "继续吧", "hi", "hello", "hey", "嗨", "你好", "在吗", "在么",
    "test", "测试", "测试一下",
]
# Patterns of the gate, of discardable and of vague records.
SWEAR = r"(他妈的|操|fuck|fucking|shit|damn|傻逼|草|妈的|滚|煞笔|智障)"
SWEAR_RECORD = r"(他妈的|操|fuck|shit|damn|傻逼|草|妈的)"
VENT = r"^(今天好累|好困|饿了|无聊|没什么|嗯+|啊+|哦+)\s*[。.!！]?$"
VAGUE = [
    r"充满了(快乐|幸福|回忆|欢乐|爱|童年|阳光)",
    r"主要是|基本上是|总的来说|一般般|还不错",
    r"的性格|的特点|的为人|很认真|很善良|很正能量|很好|很棒",
    r"生活充满了|日常就是|平时就是",
]
# Words that never are entities.
TOOL_WORDS = [
    "召回", "记忆", "实体", "关系", "抽取", "嵌入", "向量", "数据库", "知识", "图谱", "存储", "检索", "写入", "节点", "边缘",
    "KO", "ko", "summary", "relation", "entity", "embedding", "qdrant", "neo4j", "memoryos", "openclaw", "bge", "m3",
]
# Words that the lexical index leaves out.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你",
    "会", "着", "没有", "看", "好", "自己", "这", "那", "他", "她", "它", "们", "吗", "吧", "啊", "呢", "哦", "嗯", "噢", "呀",
    "a", "b", "c", "i", "the", "is", "to", "and", "of", "in",
]
# What splits a query's words into what is asked for and whom it is about.
QUERY_STOP_WORDS = [
    "的", "了", "吗", "呢", "啊", "吧", "么", "什么", "怎么", "如何", "为啥", "为什么", "在", "和", "跟", "与", "及", "一个", "一起", "有", "是", "就", "都", "也", "还",
    "这", "那", "我", "你", "他", "她", "它", "我们", "你们", "他们", "最近", "现在", "经常", "平时", "喜欢", "想要", "会", "能", "可以", "做", "哪里", "谁",
]
ATTRIBUTE_NOUNS = [
    "习惯", "爱好", "性格", "特点", "饮食", "口味", "偏好", "喜好", "兴趣", "日常", "生活", "工作", "学习", "穿着", "长相", "外貌", "家庭", "身体", "健康", "运动", "娱乐", "休闲",
]
ATTRIBUTE_ROOTS = ["习惯", "爱好", "性格", "特点", "饮食", "口味", "偏好", "喜好", "兴趣", "长相", "外貌", "日常", "穿着"]
PRIVACY_WORDS = ["密码", "账号", "余额", "银行卡", "支付", "转账", "验证码", "登录"]
GENERIC_VERBS = [
    "做事", "发生", "进行", "开始", "继续", "起来", "成为", "觉得", "感到", "认为", "干", "做", "搞", "弄", "记", "记得", "知道", "想", "说", "讲", "问", "告诉", "了解",
    "好玩", "开心", "快乐", "高兴", "有趣",
]
