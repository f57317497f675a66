"""Fixed values that results depend on."""

# Stop words and junk terms of topic keywords.
STOP_WORDS = (
    "и в во на с со по для не нет да что это как из у к ко о об а но или же ли бы то все всё всего уже ещё еще если так там тут при про "
    "над под от до без через я мы вы он она они оно мне меня мой моя мои вас вам ваш ваша ваши нам нас наш наша наши the a an is are was "
    "were be to of in on at for with and or not this that it you your i we they none null nan true false unknown undefined assistant "
    "user bot system здравствуйте подскажите пожалуйста можно можем"
).split()
JUNK_TERMS = "none null nan true false unknown undefined assistant user bot system empty пусто".split()

# Roles in reply timing, and message types that stand for a role.
USER_ROLES = "user human client customer end_user enduser player пользователь клиент абонент".split()
ASSISTANT_ROLES = "assistant operator bot assistant_bot model agent ai оператор ассистент".split()
MESSAGE_ROLES = {"human": "user", "client": "user", "customer": "user", "end_user": "user", "bot": "assistant", "ai": "assistant", "operator": "operator"}

# Words that stand for a passed or failed criterion of a judge, and for a rater's label.
CRITERION_TRUE = "1 true yes да pass passed".split()
CRITERION_FALSE = "0 false no нет fail failed".split()
LABEL_TRUE = "true 1 yes да pass успех ok success".split()
LABEL_FALSE = "false 0 no нет fail ошибка bad".split()

# Fields of a judge's answer that aren't scored; older label fields; the unnamed rater.
META_FIELDS = "reason details comment explanation note".split()
LEGACY_LABELS = "human_label gold_label reference_label expected_result human_verdict".split()
UNNAMED_RATER = "(без имени)"

# Key names that are redacted, and what stands in their place.
SECRET_KEYS = "secretaccesskey accesskey secretkey awsaccesskeyid awssecretaccesskey apikey password authorization token refreshtoken privatekey minioaccesskey miniosecretkey".split()
REDACTED = "[скрыто]"

# Clusters, texts for embedding, defaults.
NOISE, NO_EMBEDDING = -1, -2
NOISE_LABEL, NO_KEYWORDS, NO_GOAL, NO_CATEGORY, EMPTY = "шум", "ключевые слова не выявлены", "Без цели", "(без category)", "(пусто)"
HISTORY_FIELDS = ("dialog", "assistant", "user")
RESERVED_FIELDS = ("history", "cluster_id", "cluster_label", "topic_keywords")
HISTORY_CHARS, FIELD_CHARS, EMPTY_FIELD = 8000, 1000, "[пустой {field}]"
# what stands between words, and a word of two characters or more that doesn't begin with a digit or underscore
BETWEEN_TOKENS = r"[^\p{L}\p{N}_]+"
TOKEN = r"^[\p{L}\p{Nl}\p{No}]."
MAX_TERM = 24
Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
