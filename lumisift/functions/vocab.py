"""Word lists of the tag rules."""

# These lists must equal the reference's for right results (Apache-2.0, see NOTICE).

SOURCE_METADATA = [
    "artist_name", "artist_signature", "commission", "copyright_name", "fanbox_username", "logo", "patreon_logo",
    "patreon_username", "pixiv_id", "pixiv_username", "qr_code", "sample_watermark", "signature", "text_focus",
    "twitter_username", "username", "watermark", "web_address",
]
CENSOR = [
    "bar_censor", "blur_censor", "censor_bar", "censored", "convenient_censoring", "light_censor", "mosaic_censoring",
    "uncensored",
]
BOORU_METADATA = [
    "artist_request", "character_request", "commentary", "commentary_request", "copyright_request", "source_request", "tagme",
    "translated", "translation_request",
]
QUALITY = [
    "bad_anatomy", "bad_hands", "blurry", "compression_artifacts", "error", "jpeg_artifacts", "lowres", "scan_artifacts",
]
OPTIONAL_TEXT = ["chinese_text", "english_text", "japanese_text", "korean_text", "speech_bubble", "subtitle", "text"]
DENYLIST = SOURCE_METADATA + CENSOR + BOORU_METADATA + QUALITY

PEOPLE = ["couple", "duo", "group", "multiple_boys", "multiple_girls", "multiple_others", "solo"]
PEOPLE_PATTERN = r"^\d+(girls?|boys?|others?)$"
CROWD_PATTERN = r"^([3-9]|\d{2,})(girls|boys|others)$"
FRAMING = ["close-up", "close_up", "cowboy_shot", "full_body", "upper_body"]
LOCATION_ROOTS = ["indoors", "outdoors"]
INDOOR = ["indoors", "bedroom", "classroom", "office", "kitchen", "bathroom", "living_room"]

EYE_COLOR = [
    "aqua_eyes", "black_eyes", "blue_eyes", "brown_eyes", "green_eyes", "grey_eyes", "orange_eyes", "pink_eyes", "purple_eyes",
    "red_eyes", "white_eyes", "yellow_eyes",
]
EYE_COLOR_EXCEPTIONS = ["heterochromia", "multicolored_eyes"]
HAIR_COLOR = [
    "aqua_hair", "black_hair", "blonde_hair", "blue_hair", "brown_hair", "green_hair", "grey_hair", "orange_hair", "pink_hair",
    "purple_hair", "red_hair", "white_hair",
]
HAIR_COLOR_EXCEPTIONS = [
    "colored_inner_hair", "gradient_hair", "multicolored_hair", "split-color_hair", "streaked_hair", "two-tone_hair",
]
HAIR_LENGTH = ["bald", "long_hair", "medium_hair", "short_hair", "very_long_hair", "very_short_hair"]
EYE_STATE = ["closed_eyes"]
MOUTH_STATE = ["closed_mouth", "open_mouth"]
BREAST_SIZE = ["flat_chest", "huge_breasts", "large_breasts", "medium_breasts", "small_breasts"]
BREAST_SIZE_EXCEPTIONS = ["alternate_breast_size"]
AGE = ["adult", "child", "mature_female", "teenage"]
FOOTWEAR = [
    "ankle_socks", "boots", "high_heels", "kneehighs", "loafers", "mary_janes", "pantyhose", "sandals", "shoes", "slippers",
    "sneakers", "socks", "thighhighs",
]
FOOTWEAR_EXCEPTIONS = [
    "barefoot_sandals", "shoe_removal", "shoes_removed", "single_shoe", "single_sock", "sock_removal", "socks_removed",
    "toeless_socks",
]
BACKGROUND_COLOR = [
    "black_background", "blue_background", "green_background", "grey_background", "orange_background", "pink_background",
    "purple_background", "red_background", "white_background", "yellow_background",
]
BACKGROUND_COLOR_EXCEPTIONS = ["gradient_background", "multicolored_background", "split_background", "two-tone_background"]
TIME = ["day", "night"]
TIME_EXCEPTIONS = ["sunrise", "sunset", "twilight"]
CAMERA_ANGLE = ["from_above", "from_below"]
MULTI_VIEW = ["image_sample", "multiple_views", "reference_sheet", "split_screen"]
SOLO_PAIRS = [
    ["closed_eyes", "looking_at_viewer"],
    ["closed_mouth", "open_mouth"],
    ["completely_nude", "fully_clothed"],
    ["expressionless", "grin"],
    ["expressionless", "laughing"],
    ["expressionless", "smile"],
    ["facing_away", "facing_viewer"],
    ["frown", "smile"],
    ["kneeling", "standing"],
    ["looking_at_viewer", "looking_away"],
    ["lying", "sitting"],
    ["lying", "standing"],
    ["sitting", "standing"],
    ["squatting", "standing"],
]
GLOBAL_PAIRS = [
    ["detailed_background", "simple_background"],
    ["scenery", "white_background"],
]
HIGH_RISK = ["alternate_breast_size", "humiliation", "masochism", "mind_control", "sadism"]
SUPPORT = {
    "humiliation": ["blush", "crying", "embarrassed", "public"],
    "masochism": ["bdsm", "bondage", "crying", "pain", "spanking", "whip"],
    "mind_control": ["empty_eyes", "hypnosis", "hypnotic_eyes", "spiral_eyes"],
    "pet_play": ["animal_collar", "cat_girl", "collar", "dog_girl", "leash", "paw_pose", "viewer_holding_leash"],
    "sadism": ["bdsm", "pain", "torture", "whip"],
}
SUPPORT_LEAST = {"pet_play": 2}

CATEGORY_ORDER = [
    "action_composition", "interaction_concept", "key_appearance", "accessory_setting", "body_state", "expression_state",
    "background", "other",
]
ACTION_TAGS = [
    "back_to_viewer", "depth_of_field", "dynamic_angle", "dynamic_pose", "facing_viewer", "foreshortening", "from_above",
    "from_behind", "from_below", "from_side", "looking_at_viewer", "looking_away", "looking_back", "looking_down", "looking_up",
    "motion_blur", "over_shoulder", "pointing", "pov", "profile", "reaching",
]
ACTION_TOKENS = [
    "dancing", "fighting", "flying", "grabbing", "holding", "jumping", "pulling", "pushing", "running", "walking",
]
INTERACTION_TAGS = [
    "arm_around_waist", "arms_around_neck", "couple", "feeding", "group_hug", "handholding", "headpat", "holding_hands", "hug",
    "hugging", "kiss", "kissing", "lap_pillow", "princess_carry", "romantic", "solo_focus", "yuri",
]
INTERACTION_PREFIXES = ["hand_on_", "breast_grab", "face_to_face"]
CONCEPT_TOKENS = ["concept", "cyberpunk", "fantasy", "horror", "romance", "romantic", "sci-fi", "theme"]
BODY_TAGS = [
    "arched_back", "arms_up", "bent_over", "bottomless", "crouching", "crossed_legs", "hands_up", "kneeling", "legs_together",
    "lying", "lying_on_back", "lying_on_side", "naked", "nude", "on_back", "on_side", "pregnant", "sitting", "spread_legs",
    "squatting", "standing", "sweat", "sweaty", "topless", "wet",
]
EXPRESSION_TAGS = [
    "angry", "blush", "closed_mouth", "clenched_teeth", "crying", "embarrassed", "expressionless", "frown", "grin", "happy",
    "laughing", "open_mouth", "parted_lips", "sad", "scared", "seductive_smile", "sleepy", "smile", "surprised", "tears", "tired",
    "tongue_out", "wink",
]
EXPRESSION_TOKENS = ["blush", "crying", "expression", "laughing", "smile", "tears"]
BACKGROUND_TAGS = [
    "bathroom", "beach", "bedroom", "blue_sky", "city", "classroom", "clouds", "day", "forest", "indoors", "kitchen", "landscape",
    "living_room", "night", "office", "outdoors", "room", "scenery", "simple_background", "sky", "street", "sunset",
]
BACKGROUND_TOKENS = [
    "background", "building", "garden", "mountain", "nature", "ocean", "park", "river", "school", "scenery", "water",
]
APPEARANCE_TOKENS = [
    "ass", "bangs", "body", "boy", "breasts", "clothes", "dress", "ears", "eye", "eyes", "face", "girl", "hair", "horns",
    "jacket", "pants", "shirt", "shorts", "skin", "skirt", "sleeves", "stockings", "suit", "tail", "thighs", "uniform",
]
ACCESSORY_TOKENS = [
    "accessory", "bag", "bow", "bracelet", "camera", "cap", "choker", "collar", "earrings", "glasses", "goggles", "halo", "hat",
    "hairpin", "jewelry", "necklace", "ornament", "phone", "piercing", "ribbon", "ring", "sword", "tattoo", "umbrella", "weapon",
    "wings",
]
ACCESSORY_TAGS = [
    "armor", "bikini", "bride", "cosplay", "gothic_lolita", "idol", "kimono", "lingerie", "maid", "magical_girl",
    "military_uniform", "nurse", "office_lady", "princess", "schoolgirl", "swimsuit", "teacher", "underwear", "warrior", "witch",
    "yukata",
]

IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
#: The kinds of relation a review may accept, and the names each has.
RELATION_TYPES = {
    "specific_attribute": ["attribute_refinement", "specific_attribute"],
    "strict_subtype": ["strict_subtype"],
    "strong_state": ["strong_state", "strong_state_refinement"],
}
#: What a selection report says of the order in which captions are made.
CAPTION_STAGES = [
    "threshold", "denylist", "selection_features", "alias", "exclusive_conflicts", "support_rules", "removable_parents", "semantic_sort", "lora_prefix", "txt_output",
]

WATERMARK_PROMPT = "Locate all the instances that matches the following description: artist signature or artist name added as attribution</c>social media handle or username overlaid on the artwork</c>website URL or copyright notice overlaid on the artwork</c>logo, ownership mark, or QR code used as a watermark</c>SAMPLE, PREVIEW, DEMO, commission, or repost restriction text</c>repeated semi-transparent watermark text or symbols."
COMIC_PROMPT = "Locate all the instances that matches the following description: comic or manga panel</c>separate image tile in a collage or image grid</c>speech bubble or dialogue balloon</c>caption box inside a comic panel."
