"""Names, tags, sizes and signatures that results depend on."""

# File extensions by kind.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "webm")

# Output formats (key, label, width, height).
TARGETS = (("45", "4:5", 1080, 1350), ("916", "9:16", 1080, 1920))

# Names of generators, in the order in which they are looked for.
GENERATOR_NAMES = (
    "midjourney", "dall-e", "dall·e", "dalle", "openai", "gpt image", "gpt-image",
    "stable diffusion", "stablediffusion", "automatic1111", "comfyui", "invokeai",
    "novelai", "adobe firefly", "firefly", "imagen", "veo", "gemini", "deepmind",
    "flux", "black forest labs", "leonardo.ai", "ideogram", "runway", "pika labs",
    "kling", "sora", "grok", "playground ai", "nightcafe", "starryai", "recraft",
    "krea", "luma", "hailuo", "seedream", "qwen-image", "nano banana",
)

# Text keys that generators write, with what they hold.
GENERATION_KEYS = {
    "parameters": "generation parameters",
    "prompt": "generation prompt",
    "workflow": "generation workflow",
    "negative_prompt": "negative prompt",
    "sd-metadata": "diffusion metadata",
    "invokeai_metadata": "generator metadata",
    "dream": "dream string",
    "aigc": "AIGC marker",
    "generation_data": "generation data",
}

# EXIF tags that cameras write.
CAMERA_TAGS = {
    271: "camera make",
    272: "camera model",
    42036: "lens model",
    33434: "exposure time",
    33437: "f-number",
    34855: "ISO",
    36867: "capture date",
    37386: "focal length",
    34853: "GPS",
}

# EXIF tags whose text is searched for names.
TEXT_TAGS = (271, 272, 305, 270, 42036)

# Sizes that generators often make.
GENERATOR_SIZES = (
    (1024, 1024), (512, 512), (768, 768), (1024, 1536), (1536, 1024),
    (1024, 1792), (1792, 1024), (1152, 896), (896, 1152), (1216, 832),
    (832, 1216), (1344, 768), (768, 1344), (1440, 1440), (2048, 2048),
    (1080, 1920), (1920, 1080), (720, 1280), (1280, 720),
)

# Byte strings that are counted in whole files, lower case, with their labels.
SIGNATURES = (
    ("c2pa", "C2PA claim data"),
    ("jumb", "JUMBF box (C2PA container)"),
    ("contentcredential", "Content Credentials"),
    ("trainedalgorithmicmedia", "C2PA assertion: AI-generated"),
    ("synthid", "SynthID reference"),
    ("http://ns.adobe.com/xap", "XMP packet"),
)

# Byte strings that an output picture must not hold.
LEFTOVER_SIGNATURES = ("c2pa", "jumb", "jumd", "contentcredentials", "urn:uuid:", "http://ns.adobe.com/xap/")

# Labels of uuid boxes.
UUID_LABELS = {
    "d8fec3d61b0e483c92975828877ec481": "C2PA / Content Credentials manifest",
    "be7acfcb97a942e89c71999491e3afac": "XMP packet",
}

# Tags of containers that say nothing about origin.
BENIGN_TAGS = ("major_brand", "minor_version", "compatible_brands", "handler_name", "vendor_id", "language")

# Labels of JPEG application segments.
APP_LABELS = {1: "EXIF / XMP", 2: "ICC profile / MPF", 11: "JUMBF (C2PA)", 13: "IPTC / Photoshop", 14: "Adobe"}

# PNG chunks that cleaning keeps, and known metadata chunks.
PNG_KEEP = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "gAMA", "cHRM", "sRGB", "bKGD")
PNG_META = {
    "tEXt": "text",
    "zTXt": "compressed text",
    "iTXt": "international text / XMP",
    "eXIf": "EXIF",
    "iCCP": "ICC profile",
    "tIME": "timestamp",
    "caBX": "C2PA (JUMBF)",
    "prVW": "preview",
}

# WebP chunks that hold metadata.
WEBP_META = ("EXIF", "XMP ", "ICCP")

# ISO boxes that hold boxes, and those whose presence is a finding.
ISO_CONTAINERS = ("moov", "udta", "meta", "ilst", "trak", "mdia", "minf", "stbl", "edts")
ISO_FINDINGS = ("udta", "ilst", "XMP_")

# Encoder names in sample descriptions, in the order in which they are looked for.
COMPRESSOR_MARKS = (b"Lavc", b"libx264", b"x264", b"AVC Coding")

# How many leading bytes are read for declarations.
DECLARATION_BYTES = 6_000_000

# Words in file names and folders that choose a format.
NAME_916 = r"(?i)(?<!\d)916(?!\d)|9x16|\breel\b|reels|\bstory\b|stories"
NAME_45 = r"(?i)(?<!\d)45(?!\d)|4x5|\bpost\b|posts|\bfeed\b"
FOLDERS_916 = ("reels", "reel", "stories", "story")
FOLDERS_45 = ("posts", "post", "feed")

# Characters that count as readable in binary data.
READABLE = r"""[A-Za-z0-9 ._:/@{}"'\[\],-]"""

# Seconds after which a job expires.
JOB_SECONDS = 7200
