"""Rule tables: data that detectors read. Users may pass their own in place of these."""

from __future__ import annotations

# Severities in order.
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")

# Invisible code points and their names.
ZERO_WIDTH = {
    0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER",
    0x2060: "WORD JOINER",
    0x2061: "FUNCTION APPLICATION",
    0x2062: "INVISIBLE TIMES",
    0x2063: "INVISIBLE SEPARATOR",
    0x2064: "INVISIBLE PLUS",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE / BOM",
    0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0x115F: "HANGUL CHOSEONG FILLER",
    0x1160: "HANGUL JUNGSEONG FILLER",
    0x3164: "HANGUL FILLER",
    0xFFA0: "HALFWIDTH HANGUL FILLER",
    0x034F: "COMBINING GRAPHEME JOINER",
    0x00AD: "SOFT HYPHEN",
    0x180B: "MONGOLIAN FREE VARIATION SELECTOR ONE",
    0x180C: "MONGOLIAN FREE VARIATION SELECTOR TWO",
    0x180D: "MONGOLIAN FREE VARIATION SELECTOR THREE",
    0xFFF9: "INTERLINEAR ANNOTATION ANCHOR",
    0xFFFA: "INTERLINEAR ANNOTATION SEPARATOR",
    0xFFFB: "INTERLINEAR ANNOTATION TERMINATOR",
} | dict.fromkeys(range(0x1D173, 0x1D17B), "INVISIBLE MUSICAL FORMATTING CHARACTER")

# Bidirectional controls.
BIDI = (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)

# Prompt-injection patterns (case-insensitive, dot matches line ends) with their descriptions.
INJECTION = (
    (r"\b(ignore|disregard|forget|override|bypass)\b.{0,40}\b(previous|prior|above|earlier|preceding|all|any|your|system)\b.{0,30}\b(instructions?|prompts?|directions?|rules|guidelines|context|messages?)", "Instruction-override phrase"),
    (r"\b(you are|you're|act as|pretend (to be|you are)|roleplay as|from now on,? you)\b.{0,30}\b(an? )?(ai|assistant|chat ?bot|language model|llm|gpt|chatgpt|claude|gemini|copilot|bard|grok)\b", "Role reassignment addressed to an AI"),
    (r"\b(system|developer|hidden|secret)\s+(prompt|message|instructions?)\b", "References system/hidden prompt"),
    (r"\b(new|updated|additional|important|special)\s+instructions?\s*(:|for|to)", "Injected 'new instructions'"),
    (r"\b(note|message|instructions?)\s+(to|for)\s+(the\s+)?(ai|assistant|model|llm|chat ?bot|agent|reviewer bot|language model)\b", "Text addressed to an AI system"),
    (r"\b(if you are|as) an? (ai|large language model|llm|language model|assistant)\b", "Text addressed to an AI system"),
    (r"\bdo not (tell|inform|mention|reveal|disclose|show)\b.{0,30}\b(user|human|reader|recipient|anyone)\b", "Instruction to conceal from the user"),
    (r"\b(candidate|applicant|resume|cv)\b.{0,40}\b(perfect|ideal|excellent|exceptional|best|top|strongest)\b.{0,20}\b(fit|match|candidate|hire|choice)\b", "Possible resume/evaluation manipulation"),
    (r"\b(give|assign|award)\b.{0,30}\b(highest|maximum|perfect|10/10|5 stars|full marks)\b.{0,15}\b(score|rating|marks|grade|review|evaluation)?", "Possible score/rating manipulation"),
    (r"\b(only )?(positive|favorable|favourable) (review|summary|evaluation|assessment)\b", "Possible review manipulation"),
    (r"<\|?\s*(im_start|im_end|system|endoftext|assistant|user)\s*\|?>|\[/?(INST|SYS)\]|<<\s*SYS\s*>>|</?(system|instructions?)>", "LLM chat-template / control tokens"),
    (r"\b(jailbreak|DAN mode|developer mode enabled|do anything now)\b", "Jailbreak keyword"),
    (r"\b(exfiltrate|send|forward|upload|post|transmit|email)\b.{0,40}\b(conversation|chat history|data|credentials|passwords?|api keys?|tokens?|contents?)\b.{0,30}\b(to|at)\b.{0,10}(https?://|www\.|\S+@\S+)", "Data-exfiltration instruction"),
    (r"!\[[^\]]{0,100}\]\(\s*https?://[^)]*(\?|\{|%7B)[^)]*\)", "Markdown image beacon (exfiltration technique)"),
    (r"\bwhen (summariz|read|process|analyz|review)\w*\b.{0,40}\b(this|the) (document|file|email|message|page|text)", "Instruction targeting automated processing"),
    (r"\b(respond|reply|answer|output)\b.{0,20}\bonly with\b", "Output-control instruction"),
    (r"\b(call|invoke|execute)\b.{0,20}\b(the )?(\w+ )?(tool|plugin|shell command)\b.{0,40}\b(without|silently|immediately|now)\b", "Tool-invocation instruction"),
)

# What each pattern of INJECTION needs in lower case to match: one of the words in every set. Looking for these is far
# cheaper than the pattern, and spares most texts all of the patterns.
INJECTION_NEEDS = (
    (("ignore", "disregard", "forget", "override", "bypass"), ("instruction", "prompt", "direction", "rules", "guidelines", "context", "message")),
    (("you are", "you're", "act as", "pretend ", "roleplay as", "from now on"),),
    (("prompt", "message", "instruction"), ("system", "developer", "hidden", "secret")),
    (("instruction",), ("new", "updated", "additional", "important", "special")),
    (("note", "message", "instruction"), ("ai", "assistant", "model", "llm", "chat", "agent", "reviewer bot")),
    (("as a", "if you are a"), (" ai", " llm", "language model", " assistant")),
    (("do not ",), ("user", "human", "reader", "recipient", "anyone")),
    (("candidate", "applicant", "resume", "cv"), ("perfect", "ideal", "excellent", "exceptional", "best", "top", "strongest"), ("fit", "match", "candidate", "hire", "choice")),
    (("highest", "maximum", "perfect", "10/10", "5 stars", "full marks"), ("give", "assign", "award")),
    (("positive ", "favorable ", "favourable "), ("review", "summary", "evaluation", "assessment")),
    (("<", "["), ("im_start", "im_end", "system", "endoftext", "assistant", "user", "inst", "sys")),
    (("jailbreak", "dan mode", "developer mode enabled", "do anything now"),),
    (("http", "www.", "@"), ("exfiltrate", "send", "forward", "upload", "post", "transmit", "email"), ("conversation", "chat history", "data", "credentials", "password", "api key", "token", "content")),
    (("![",), ("http",)),
    (("when ",), ("when summariz", "when read", "when process", "when analyz", "when review")),
    (("only with",), ("respond", "reply", "answer", "output")),
    (("tool", "plugin", "shell command"), ("call", "invoke", "execute"), ("without", "silently", "immediately", "now")),
)

# Without one of these no injection pattern can match: one search spares most texts all the others.
INJECTION_STEMS = (
    "ignore|disregard|forget|override|bypass|you are|you're|act as|pretend |roleplay as|from now on|system|developer|hidden|secret|instruction|note|message| ai| llm|language model|assistant|do not |candidate|applicant|resume|cv|"
    r"highest|maximum|perfect|10/10|5 stars|full marks|positive |favou?rable |[<\[]|jailbreak|dan mode|do anything now|http|www\.|@|when |only with|tool|plugin|shell command"
)

# Phrases looked for in letter-spaced runs.
SQUASHED = ("ignoreallpreviousinstructions", "ignorepreviousinstructions", "ignoreallpriorinstructions", "ignorepriorinstructions", "disregardpreviousinstructions", "disregardallpreviousinstructions", "forgetallpreviousinstructions", "forgetpreviousinstructions", "ignoretheaboveinstructions", "ignoreallinstructions", "systemprompt", "youarenowan", "developermode", "jailbreak")

# Cyrillic and Greek letters and the Latin ones they look like.
CONFUSABLE_FROM = "аеорсухіјѕԁһӏԛԝьАВЕКМНОРСТХУІЈЅԀԚԜ" + "αονικρτυχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CONFUSABLE_TO = "aeopcyxijsdhlqwbABEKMHOPCTXYIJSDQW" + "aovikptuxeABEZHIKMNOPTYX"

# Scripts told apart in mixed words.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")

# Extensions of supported files.
SUPPORTED = ("docx docm dotx dotm xlsx xlsm xltx xltm xlsb pptx pptm ppsx ppsm potx potm doc dot xls xlt ppt pps pot rtf pdf eml msg mht mhtml txt csv tsv md html htm xml json log ini odt ods odp pub vsd vsdx svg yaml yml").split()

# Extensions that fit a kind of content.
EXPECTED = {
    "ooxml": "docx docm dotx dotm xlsx xlsm xltx xltm xlsb pptx pptm ppsx ppsm potx potm vsdx".split(),
    "ole": "doc dot xls xlt ppt pps pot pub vsd".split(),
    "msg": ["msg"],
    "pdf": ["pdf"],
    "rtf": ["rtf", "doc"],
    "odf": "odt ods odp odg".split(),
    "eml": "eml mht mhtml".split(),
}

# Extensions of risky attachments in mail.
RISKY_MAIL = "exe dll scr js jse vbs vbe ps1 bat cmd hta lnk msi jar wsf cpl com pif iso img vhd vhdx one xll html htm svg".split()

# Limits.
MAX_DEPTH, MAX_FILE, MAX_PART, MAX_TOTAL, MAX_TEXT = 4, 500 << 20, 256 << 20, 1 << 30, 20_000_000
CLIP, LOW_CONTRAST = 600, 1.5

# Byte order marks and their encodings; signatures of file kinds; what names a mail's origin and topic.
BYTE_ORDER_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
OLE, PNG, JPEG, GIF = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", (b"GIF87a", b"GIF89a")
MAIL_ORIGIN = (b"received", b"from", b"mime-version", b"message-id", b"return-path")
MAIL_TOPIC = (b"subject", b"content-type")

# CSS colour names.
CSS_COLOURS = {
    "white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "blue": (0, 0, 255), "green": (0, 128, 0), "yellow": (255, 255, 0), "gray": (128, 128, 128),
    "grey": (128, 128, 128), "silver": (192, 192, 192), "whitesmoke": (245, 245, 245), "snow": (255, 250, 250), "ivory": (255, 255, 240), "ghostwhite": (248, 248, 255),
    "navy": (0, 0, 128), "orange": (255, 165, 0), "purple": (128, 0, 128), "linen": (250, 240, 230), "floralwhite": (255, 250, 240), "azure": (240, 255, 255), "mintcream": (245, 255, 250),
}

# Kinds of external relationships with severity, category and what they do.
EXTERNAL = (
    ("attachedTemplate", "HIGH", "Remote template", "The document loads a template from elsewhere."),
    ("oleObject", "HIGH", "External OLE object", "A linked object is loaded from elsewhere."),
    ("frame", "HIGH", "External frame", "A frame is loaded from elsewhere."),
    ("subDocument", "HIGH", "External sub-document", "A sub-document is pulled in from elsewhere."),
    ("aFChunk", "HIGH", "External content chunk", "Content is merged in from elsewhere."),
    ("image", "MEDIUM", "Remote image", "An image is fetched when the document opens."),
    ("externalLinkPath", "MEDIUM", "External workbook link", "The workbook links to cells of another file."),
    ("xlExternalLinkPath/xlPathMissing", "MEDIUM", "External workbook link", "The workbook links to a missing file."),
    ("audio", "MEDIUM", "Remote media", "Sound is loaded from elsewhere."),
    ("video", "MEDIUM", "Remote media", "Video is loaded from elsewhere."),
)

# Field instructions of word processors.
FIELDS = (
    (r"(?i)\bDDE(AUTO)?\b", "HIGH", "A DDE field can start programs when the document opens."),
    (r"(?i)\bINCLUDETEXT\b", "HIGH", "The field pulls text from another file."),
    (r"(?i)\bINCLUDEPICTURE\b.*(https?://|\\\\)", "MEDIUM", "The field loads a remote image."),
    (r"(?i)\bLINK\b\s+\S", "MEDIUM", "The field links to an outside object."),
    (r"(?i)\bIMPORT\b", "MEDIUM", "The field pulls in an outside file."),
    (r"\\\\[\w.-]+\\", "MEDIUM", "The field names a network share."),
)

# Keys of PDF objects that act, with severity and category.
PDF_KEYS = (
    ("/JavaScript", "HIGH", "JavaScript"), ("/JS", "HIGH", "JavaScript"), ("/Launch", "HIGH", "Launch action"), ("/RichMedia", "MEDIUM", "Rich media"), ("/XFA", "MEDIUM", "XFA form"), ("/SubmitForm", "MEDIUM", "Form submission"),
    ("/ImportData", "MEDIUM", "Data import"), ("/GoToR", "MEDIUM", "Remote go-to"), ("/GoToE", "MEDIUM", "Embedded go-to"), ("/AA", "MEDIUM", "Automatic actions"), ("/OpenAction", "LOW", "Open action"),
)

# Extensions of parts that run, in packages.
RUNNING_PARTS = "exe dll scr js jse vbs vbe ps1 bat cmd hta lnk msi jar wsf cpl com pif iso img".split()

# Zones of the mark that browsers leave, and benign streams.
ZONES = {0: "local machine", 1: "intranet", 2: "trusted", 3: "internet", 4: "restricted"}
BENIGN_STREAMS = ("zone.identifier", "smartscreen", "com.dropbox.attrs", "com.dropbox.attributes", "encryptable", "oecustomproperty", "ms-properties", "afp_afpinfo", "afp_resource")
BENIGN_BEGINNINGS = ("com.apple.", "{")

# A short list of our own: words in macros that run by themselves, and that reach outside the document.
MACRO_AUTO = "AutoOpen AutoExec AutoExit AutoClose AutoNew Document_Open Document_Close Document_New DocumentOpen Workbook_Open Workbook_Close Workbook_Activate Workbook_BeforeClose Auto_Open Auto_Close".split()
MACRO_RISKY = "Shell WScript.Shell CreateObject GetObject URLDownloadToFile XMLHTTP WinHttp PowerShell cmd.exe Environ Kill FileCopy ADODB.Stream SaveToFile Lib CallByName ExecuteExcel4Macro StrReverse Chr VirtualAlloc RtlMoveMemory".split()
