"""The patterns that tell behaviors apart, and those that a segmenter protects.

All match without regard to case. Classes stand in the order in which they win."""

from __future__ import annotations


#: Seven classes; a sentence without a match is F.
SEVEN: dict[str, tuple[str, ...]] = {
    "B": (
        r"(?:no|wait),?\s+that(?:'s|\s+is)\s+(?:wrong|incorrect|not\s+right|not\s+correct)",
        r"\bi\s+(?:made|have)\s+(?:a\s+|an\s+)?(?:error|mistake)",
        r"\bthat\s+(?:was|is)\s+(?:a\s+)?(?:mistake|error|wrong)",
        r"\blet\s+me\s+(?:reconsider|rethink|re-examine|redo\s+(?:this|that))",
        r"\bgoing\s+back\s+to\b",
        r"\bi\s+(?:was|am)\s+wrong\b",
        r"\bthat\s+(?:doesn't|does\s+not)\s+(?:work|seem\s+right|look\s+right|make\s+sense)",
        r"\bthis\s+(?:is|seems)\s+(?:wrong|incorrect)\b",
        r"\bcorrection\s*:",
        r"\bwait\b.*?\b(?:wrong|mistake|error|incorrect|no\b)",
        r"\bwait\b.*?\b(?:actually|should\s+be|instead)\b",
        r"^wait\b(?!.*?(?:let\s+me\s+(?:check|verify)))",
        r"^actually\b",
    ),
    "R": (
        r"\blet\s+me\s+try\s+(?:a\s+)?(?:different|another|new)\s+(?:approach|method|way|strategy)",
        r"\bstarting\s+(?:over|from\s+scratch|fresh|again)\b",
        r"\bscrap(?:ping)?\s+(?:this|that)\b",
        r"\babandoning?\s+(?:this|that)\s+(?:approach|method|idea)",
        r"\blet(?:'s|\s+me)\s+(?:take|use)\s+(?:a\s+)?(?:different|another|new)\s+approach",
        r"\binstead,?\s+(?:let\s+me|i(?:'ll|\s+will))\b",
        r"\balternatively\b",
        r"\banother\s+(?:way|approach|method)\s+(?:to|would\s+be|is)\b",
        r"\bapproaching?\s+(?:this|it)\s+differently\b",
        r"\blet(?:'s|\s+me)\s+(?:try|consider)\s+(?:something\s+else|another)\b",
    ),
    "V": (
        r"\blet\s+me\s+(?:check|verify|confirm|validate|double[\s-]?check|make\s+sure)",
        r"\bto\s+(?:verify|confirm|check|validate)\b",
        r"\bdouble[\s-]?check(?:ing)?\b",
        r"\bsanity\s+check\b",
        r"\bchecking\s+(?:this|that|my|our|the)\b",
        r"\bis\s+(?:this|that)\s+(?:correct|right|true|valid)\?",
        r"\bverif(?:ying|ication)\b",
        r"\blet(?:'s|\s+me)\s+(?:see|make\s+sure)\b",
        r"\blet\s+me\s+(?:re-?read|review)\b",
        r"\bsubstitut(?:e|ing)\s+(?:back|this|that)\s+(?:into|in)\b",
        r"\bplug(?:ging)?\s+(?:this|it|that)\s+(?:back\s+)?in\b",
        r"\bwait\b.*?\blet\s+me\s+(?:check|verify)\b",
    ),
    "C": (
        r"\\boxed\{",
        r"\bthe\s+(?:final\s+)?answer\s+is\b",
        r"\btherefore,?\s+(?:the\s+)?(?:answer|solution|result)\b",
        r"\bin\s+conclusion\b",
        r"\bso\s+(?:the\s+)?(?:final\s+)?answer\b",
        r"\bthus,?\s+(?:the\s+)?(?:answer|solution|result)\b",
        r"\bhence,?\s+(?:the\s+)?(?:answer|solution|result)\b",
        r"\bour\s+(?:final\s+)?answer\s+is\b",
        r"\bfinal\s+answer\s*:",
    ),
    "S": (
        r"\bfirst,?\s+(?:i\s+need\s+to|we\s+need\s+to|let(?:'s|\s+me))\b",
        r"\bstep\s+\d+\s*[:.]",
        r"\bbreaking\s+(?:this|it)\s+down\b",
        r"\bthe\s+key\s+(?:insight|idea|observation|step)\s+is\b",
        r"\bto\s+solve\s+this,?\s+(?:i|we)\s+(?:need|should|must|can)\b",
        r"\bmy\s+(?:plan|approach|strategy)\s+is\b",
        r"\blet(?:'s|\s+me)\s+(?:start|begin)\s+(?:by|with)\b",
        r"\b(?:i|we)\s+need\s+to\s+find\b",
        r"\bthe\s+(?:first|next)\s+step\s+is\b",
        r"\blet(?:'s|\s+me)\s+(?:set\s+up|formulate|define)\b",
    ),
    "H": (
        r"\bhmm+\b",
        r"\buhh?\b",
        r"\bumm?\b",
        r"\bi(?:'m|\s+am)\s+not\s+(?:sure|certain|confident)\b",
        r"\bnot\s+(?:sure|certain)\s+(?:if|whether|about|how)\b",
        r"\bthis\s+(?:is|seems)\s+(?:tricky|confusing|difficult|complicated|hard)\b",
        r"\bi\s+wonder\b",
        r"\bperhaps\b(?!.*\bapproach\b)",
        r"^maybe\b",
        r"\bi\s+(?:think|guess|suppose)\s+(?:so|that)\b",
        r"\bi(?:'m|\s+am)\s+(?:confused|unsure|uncertain)\b",
    ),
}

#: Six classes; a sentence without a match is F.
SIX: dict[str, tuple[str, ...]] = {
    "X": (
        r"(?:no|wait|oh)[,.]?\s*that(?:'s|\s+is)\s+(?:wrong|incorrect|not\s+right|not\s+correct)",
        r"\bi\s+(?:made|have|had)\s+(?:a\s+|an\s+)?(?:error|mistake|miscalculation|blunder)",
        r"\bthat\s+(?:was|is)\s+(?:a\s+)?(?:mistake|error|wrong|incorrect)\b",
        r"\blet\s+me\s+(?:reconsider|rethink|re-?examine|re-?do|redo)\b",
        r"\bgoing\s+back\s+to\b",
        r"\bi\s+(?:was|am|had\s+been)\s+wrong\b",
        r"\bthat\s+(?:doesn't|does\s+not|won't|will\s+not)\s+(?:work|hold|make\s+sense|be\s+right|be\s+correct)",
        r"\bthis\s+(?:is|seems|appears)\s+(?:wrong|incorrect|off|invalid)\b",
        r"\bcorrection\s*[:—]",
        r"\bi\s+(?:need\s+to\s+)?(?:fix|correct)\s+(?:this|that|my\s+(?:error|mistake|calculation))\b",
        r"\bmy\s+(?:earlier|previous|prior)\s+(?:calculation|answer|reasoning|step)\s+(?:was|is)\s+(?:wrong|incorrect|off)\b",
        r"\bwait\b.{0,60}\b(?:wrong|mistake|error|incorrect|no\b)",
        r"\bwait\b.{0,60}\b(?:actually|should\s+be|instead|but)\b",
        r"^actually[,.]",
        r"^wait[,.!]?\s*(?!let\s+me\s+(?:check|verify|think))",
        r"^no[,.!]\s",
        r"^oops\b",
    ),
    "R": (
        r"\blet\s+me\s+try\s+(?:a\s+)?(?:different|another|new|completely\s+different)\s+(?:approach|method|way|strategy|angle)",
        r"\blet(?:'s|\s+me)\s+(?:take|use)\s+(?:a\s+)?(?:different|another|new)\s+(?:approach|path|route|tack)",
        r"\bstart(?:ing)?\s+(?:over|from\s+scratch|from\s+the\s+beginning|fresh|again)\b",
        r"\bscrap(?:ping|ped)?\s+(?:this|that|everything\s+above)\b",
        r"\babandon(?:ing|ed)?\s+(?:this|that|the\s+current)\s+(?:approach|method|idea|strategy)\b",
        r"\binstead[,.]?\s+(?:let\s+me|i(?:'ll|\s+will|'d|'ve)|we\s+(?:can|could|should))\b",
        r"\balternatively[,.]?\s+(?:i|we|let(?:'s|\s+me))\b",
        r"\banother\s+(?:way|approach|method|strategy)\s+(?:to|would\s+be|is|might\s+be)\b",
        r"\bapproach(?:ing)?\s+(?:this|the\s+problem)\s+differently\b",
        r"\blet(?:'s|\s+me)\s+(?:try|consider)\s+(?:something\s+else|a\s+different|an\s+alternative)\b",
        r"\bpivoting?\s+to\b",
        r"\bswitching?\s+(?:to|approach|strategy|method)\b",
    ),
    "V": (
        r"\blet\s+me\s+(?:check|verify|confirm|validate|double[\s-]?check|make\s+sure)\b",
        r"\bto\s+(?:verify|confirm|check|validate|be\s+sure)\b",
        r"\bdouble[\s-]?check(?:ing|ed)?\b",
        r"\bsanity[\s-]?check\b",
        r"\bchecking\s+(?:this|that|my|our|the)\b",
        r"\bverif(?:y|ying|ied|ication)\b",
        r"\bconfirm(?:ing|ed|ation)?\s+(?:this|that|the|my)\b",
        r"\bis\s+(?:this|that)(?:\s+\w+)?\s+(?:correct|right|true|valid|consistent)\s*\?",
        r"\bsubstitut(?:e|ing|ed)\s+(?:back|this|that)\s+(?:into|in|to\s+check)\b",
        r"\bplug(?:ging|ged)?\s+(?:back\s+)?(?:this|it|that|x\s*=|the\s+value)\s+(?:back\s+)?(?:in|into)\b",
        r"\bcheck(?:ing|ed)?\s+by\s+(?:substitut|plug|comput|calculat)\w+\b",
        r"\blet\s+me\s+(?:re-?read|review|look\s+(?:at|over)\s+(?:this|that|my\s+work))\b",
        r"\breviewing?\s+(?:my|the)\s+(?:work|steps|calculation|answer)\b",
        r"\bwait\b.{0,40}\blet\s+me\s+(?:check|verify|confirm)\b",
        r"\bdoes\s+(?:this|that)\s+(?:make\s+sense|check\s+out|add\s+up|work)\s*\?",
        r"\bare\s+(?:these|those|my)\s+(?:values|numbers|answers|steps)\s+correct\s*\?",
    ),
    "C": (
        r"\\boxed\{",
        r"\bthe\s+(?:final\s+)?answer\s+is\b",
        r"\btherefore[,.]?\s+(?:the\s+)?(?:answer|solution|result|value)\b",
        r"\bso\s+(?:the\s+)?(?:final\s+)?(?:answer|solution|result)\b",
        r"\bthus[,.]?\s+(?:the\s+)?(?:answer|solution|result)\b",
        r"\bhence[,.]?\s+(?:the\s+)?(?:answer|solution|result)\b",
        r"\bin\s+conclusion[,.]?\s",
        r"\bour\s+(?:final\s+)?answer\s+is\b",
        r"\bfinal\s+answer\s*[:=]",
        r"\bthe\s+solution\s+(?:is|to\s+this\s+problem\s+is)\b",
        r"\bwe\s+(?:get|obtain|have|conclude)\s+(?:that\s+)?(?:the\s+)?(?:answer|solution)\b",
        r"\bto\s+summarize[,.]?\s",
    ),
    "H": (
        r"\bhmm+\b",
        r"\buhh*\b",
        r"\bumm*\b",
        r"\bhuh\b",
        r"\bi(?:'m|\s+am)\s+not\s+(?:sure|certain|confident|quite\s+sure)\b",
        r"\bnot\s+(?:sure|certain)\s+(?:if|whether|about|how|what|why)\b",
        r"\bi(?:'m|\s+am)\s+(?:confused|unsure|uncertain|unclear)\b",
        r"\bi\s+(?:don't|do\s+not)\s+(?:know|understand|see)\s+(?:how|why|what|if|whether)\b",
        r"\bthis\s+(?:is|seems)\s+(?:tricky|confusing|difficult|complicated|hard|unclear)\b",
        r"\bi\s+(?:find\s+)?(?:this|it)\s+(?:confusing|unclear|hard\s+to)\b",
        r"\bi\s+wonder\s+(?:if|whether|how|what|why)\b",
        r"\bmaybe\b(?!.*\b(?:approach|method|way|instead)\b)",
        r"^perhaps\b",
        r"\bi\s+(?:think|guess|suppose|believe)\s+(?:so\b|that\s+might|this\s+might|it\s+(?:might|could|may))\b",
        r"\bthis\s+(?:might|may|could)\s+(?:be|work|help)\b",
    ),
}

#: The older classes; the first that matches wins.
LEGACY: dict[str, tuple[str, ...]] = {
    "C": (
        r"\bthe (?:final )?answer is\b",
        r"\btherefore[,.]",
        r"\bin conclusion\b",
        r"\bthus[,.]",
        r"\bhence[,.]",
        r"\\boxed\{",
        r"\bso the answer\b",
        r"\bfinal answer\b",
    ),
    "B": (
        r"\bwait[,.]?\s",
        r"\bwait,?\s+(?:no|actually|that|let me|i )",
        r"\bactually[,.]",
        r"\bno,? that'?s? (?:wrong|incorrect|not right|a mistake)\b",
        r"\bi (?:made|made an|have a) (?:mistake|error|miscalculation)\b",
        r"\blet me (?:reconsider|re-?think|re-?examine|correct)\b",
        r"\bthat'?s? (?:not right|incorrect|wrong)\b",
        r"\bi (?:was wrong|made an error|need to redo)\b",
        r"\bhmm,?\s+(?:wait|actually|no)\b",
    ),
    "R": (
        r"\blet me try (?:a )?(?:different|another) approach\b",
        r"\bstarting over\b",
        r"\blet me start (?:over|again|fresh)\b",
        r"\balternatively[,.]",
        r"\banother (?:way|approach|method)\b",
        r"\binstead[,.]",
        r"\blet me (?:use|try|consider) a different\b",
    ),
    "V": (
        r"\blet me (?:check|verify|confirm|double.?check)\b",
        r"\bto (?:verify|confirm|check)\b",
        r"\bverif(?:y|ying|ied)\b",
        r"\blet'?s? (?:verify|check|confirm)\b",
        r"\bcheck(?:ing)? (?:this|that|my|the)\b",
        r"\bis this correct\b",
        r"\bdoes this (?:make sense|check out|work)\b",
        r"\bsanity check\b",
        r"\bplugging (?:in|back)\b",
        r"\bsubstitut(?:e|ing) back\b",
    ),
    "H": (
        r"^hmm[.,]?\s*$",
        r"^hmm[,.]?\s",
        r"\bi'?m not sure\b",
        r"\bthis is (?:tricky|confusing|unclear|complicated)\b",
        r"\bi (?:think|wonder|feel) (?:i'm|i am)?\s*(?:not sure|confused|unsure)\b",
        r"\bnot (?:quite|entirely|really) sure\b",
        r"\bthis seems? (?:off|wrong|strange|odd)\b",
    ),
    "S": (
        r"\bfirst[,.]?\s+(?:i (?:need|will|should)|let'?s?|we)\b",
        r"\bstep \d+[.:]",
        r"\bpart \d+[.:]",
        r"\bbreaking (?:this|it) down\b",
        r"\bthe key (?:insight|observation|idea) is\b",
        r"\bi (?:need|will|should) (?:find|compute|calculate|determine|solve)\b",
        r"\blet'?s? (?:first|start by|begin by|define|set up)\b",
        r"\bto (?:solve|find|compute) this[,.]",
        r"\bmy (?:plan|approach|strategy) is\b",
    ),
}

#: Expressions that keep their inner periods, in the order they are protected, with their labels.
PROTECTED = (
    (r"\\\[.*?\\\]", "DISPLAY_MATH"),
    (r"\$\$.*?\$\$", "DISPLAY_MATH"),
    (r"\\\(.*?\\\)", "INLINE_MATH"),
    (r"\$[^$\n]+?\$", "INLINE_MATH"),
    (r"\\(?:cdots|ldots|dots|vdots|ddots)", "LATEX_DOTS"),
    (r"\.{2,}", "ELLIPSIS"),
    (r"-?\d+\.\d+(?:[eE][+-]?\d+)?", "DECIMAL"),
    (r"\b(?:e\.g|i\.e|etc|vs|Fig|Eq|eq|Thm|Def|Prop|Cor|Lem|Rem|Ex|No|Dr|Mr|Mrs|Ms|St|Jr|Sr)\.", "ABBREV"),
    (r"\b[a-zA-Z]\([^)]{1,30}\)", "FUNCTION"),
    (r"\bv?\d+\.\d+(?:\.\d+)*", "VERSION"),
    (r"https?://\S+", "URL"),
)
#: Short sentences that stand alone, and what an answer or a first plan looks like.
STANDALONE = r"^\s*(?:wait|hmm+|actually|alternatively|therefore|thus|hence|so)\b|^\s*(?:let\s+me|let's)\b|^\s*(?:step\s+\d+)|^\s*(?:no,|yes,)|\?\s*$"
ANSWER_SEVEN = r"\b\d+\s*$|\\boxed\{|\b(?:answer|result)\b"
ANSWER_SIX = r"\\boxed\{|\b(?:answer|result|solution)\b|\b\d+(?:\.\d+)?\s*$"
PLAN = r"\bfind\b|\bsolve\b|\bdetermine\b|\bcalculate\b|\bcompute\b|\bshow\s+that\b|\bprove\b"
