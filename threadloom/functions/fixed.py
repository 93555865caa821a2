"""Fixed values of the conversation-memory domain.

Everything in this module is data: word lists, lookup tables, patterns and constants whose exact value decides the
result of a query.  They are kept in one place, in natural order, so that a reader can check them at a glance.
No logic lives here apart from turning the text into Python containers.
"""

from __future__ import annotations

# --- fixed values: stop words of the extractive summarizer -------------------------------------------------------
SUMMARY_STOP_WORDS = """
a an the is are was were be been being have has had do does did will would could should may might shall can need
dare ought used to of in for on with at by from as into through during before after above below between out off
over under again further then once here there when where why how all both each few more most other some such no nor
not only own same so than too very just because but and or if while about up that this it its i me my we our you
your he him his she her they them their what which who whom these those am also still
""".split()

# --- fixed values: stop words of the answer-agreement report ------------------------------------------------------
AGREEMENT_STOP_WORDS = """
the and for are but not you all can had her was one our out has his how its may new now old see way who did get let
say she too use with that this will each make like been have from they some than them then also into just more such
when very what which would about could other there their these should
""".split()

# --- fixed values: technology dictionary, "term = canonical name" -------------------------------------------------
TECHNOLOGY_TERMS = """
python = Python
javascript = JavaScript
typescript = TypeScript
java = Java
kotlin = Kotlin
swift = Swift
rust = Rust
golang = Go
ruby = Ruby
php = PHP
scala = Scala
elixir = Elixir
haskell = Haskell
clojure = Clojure
lua = Lua
perl = Perl
r lang = R
dart = Dart
zig = Zig
nim = Nim
julia = Julia
erlang = Erlang
fortran = Fortran
cobol = COBOL
assembly = Assembly
solidity = Solidity
sql = SQL
graphql = GraphQL
html = HTML
css = CSS
sass = Sass
less = LESS
react = React
next.js = Next.js
nextjs = Next.js
vue = Vue.js
nuxt = Nuxt.js
angular = Angular
svelte = Svelte
django = Django
flask = Flask
fastapi = FastAPI
express = Express.js
nestjs = NestJS
spring boot = Spring Boot
spring = Spring
rails = Ruby on Rails
laravel = Laravel
phoenix = Phoenix
gin = Gin
fiber = Fiber
actix = Actix
axum = Axum
rocket = Rocket
tailwind = Tailwind CSS
tailwindcss = Tailwind CSS
bootstrap = Bootstrap
material ui = Material UI
chakra ui = Chakra UI
shadcn = shadcn/ui
storybook = Storybook
remix = Remix
astro = Astro
gatsby = Gatsby
vite = Vite
webpack = Webpack
esbuild = esbuild
turbopack = Turbopack
pydantic = Pydantic
sqlalchemy = SQLAlchemy
alembic = Alembic
celery = Celery
pytest = pytest
jest = Jest
vitest = Vitest
playwright = Playwright
cypress = Cypress
selenium = Selenium
docker = Docker
kubernetes = Kubernetes
k8s = Kubernetes
terraform = Terraform
ansible = Ansible
jenkins = Jenkins
github actions = GitHub Actions
gitlab ci = GitLab CI
circleci = CircleCI
vercel = Vercel
netlify = Netlify
heroku = Heroku
nginx = NGINX
apache = Apache
caddy = Caddy
git = Git
npm = npm
yarn = Yarn
pnpm = pnpm
pip = pip
poetry = Poetry
cargo = Cargo
gradle = Gradle
maven = Maven
make = Make
cmake = CMake
bazel = Bazel
prometheus = Prometheus
grafana = Grafana
datadog = Datadog
sentry = Sentry
elasticsearch = Elasticsearch
kibana = Kibana
logstash = Logstash
meilisearch = Meilisearch
stripe = Stripe
twilio = Twilio
sendgrid = SendGrid
auth0 = Auth0
postgresql = PostgreSQL
postgres = PostgreSQL
mysql = MySQL
mariadb = MariaDB
sqlite = SQLite
mongodb = MongoDB
redis = Redis
memcached = Memcached
cassandra = Cassandra
dynamodb = DynamoDB
firestore = Firestore
supabase = Supabase
cockroachdb = CockroachDB
neo4j = Neo4j
influxdb = InfluxDB
clickhouse = ClickHouse
pinecone = Pinecone
weaviate = Weaviate
qdrant = Qdrant
chromadb = ChromaDB
pgvector = pgvector
milvus = Milvus
aws = AWS
amazon web services = AWS
gcp = GCP
google cloud = GCP
azure = Azure
digitalocean = DigitalOcean
cloudflare = Cloudflare
fly.io = Fly.io
railway = Railway
render = Render
lambda = AWS Lambda
s3 = Amazon S3
ec2 = Amazon EC2
ecs = Amazon ECS
eks = Amazon EKS
rds = Amazon RDS
sqs = Amazon SQS
sns = Amazon SNS
cloudfront = CloudFront
gpt-4 = GPT-4
gpt-4o = GPT-4o
gpt-3.5 = GPT-3.5
chatgpt = ChatGPT
claude = Claude
claude-3 = Claude 3
gemini = Gemini
llama = LLaMA
mistral = Mistral
mixtral = Mixtral
anthropic = Anthropic
openai = OpenAI
cohere = Cohere
hugging face = Hugging Face
huggingface = Hugging Face
langchain = LangChain
llamaindex = LlamaIndex
transformers = Transformers
pytorch = PyTorch
tensorflow = TensorFlow
keras = Keras
spacy = spaCy
stable diffusion = Stable Diffusion
midjourney = Midjourney
dall-e = DALL-E
whisper = Whisper
ollama = Ollama
"""

# --- fixed values: entity patterns (java.util.regex syntax, (?U) = Unicode classes) -------------------------------
FILE_PATH_PATTERN = (
    r"(?U)(?<!\w)(?:(?:[A-Za-z]:)?(?:[/\\])(?:[\w\-. ]+[/\\])*[\w\-. ]+\.\w{1,10}"
    r"|(?:\./|\.\\|~/|~\\)(?:[\w\-. ]+[/\\])*[\w\-. ]+)(?!\w)"
)
URL_PATTERN = r"https?://[^\s<>\"'`)\]},;]+[^\s<>\"'`)\]},;.]"
ENDPOINT_PATTERN = (
    r"(?U)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[\w\-./{}:?&=]+)|(?<!\w)(/(?:api|v\d)/[\w\-./{}:?&=]+)"
)
IMPORT_PATTERN = r"(?:(?:from\s+)([\w.]+)\s+import|import\s+([\w.]+)|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\))"
ENV_VAR_PATTERN = r"(?U)(?<!\w)([A-Z][A-Z0-9_]{2,})(?!\w)"
ENV_VAR_PREFIXES = """
API_ DB_ DATABASE_ REDIS_ AWS_ GCP_ AZURE_ SECRET_ JWT_ AUTH_ SMTP_ MAIL_ STRIPE_ SENTRY_ LOG_ DEBUG NODE_ENV PYTHON
PORT HOST OPENAI_ ANTHROPIC_ GOOGLE_ NEXT_PUBLIC_
""".split()
CODE_SYMBOL_PATTERN = (
    r"(?:(?:def|function|func|fn)\s+(\w+)|(?:class|struct|enum|interface|type)\s+(\w+)"
    r"|(?:const|let|var|val)\s+(\w+)\s*=)"
)

# --- fixed values: verbs that relate two entities ------------------------------------------------------------------
RELATION_VERBS = [
    ("uses", "uses"),
    ("utilizes", "uses"),
    ("employs", "uses"),
    ("leverages", "uses"),
    ("depends on", "depends_on"),
    ("requires", "depends_on"),
    ("needs", "depends_on"),
    ("part of", "part_of"),
    ("inside", "part_of"),
    ("within", "part_of"),
    ("belongs to", "part_of"),
    ("implements", "implements"),
    ("realizes", "implements"),
    ("provides", "implements"),
    ("created by", "created_by"),
    ("built by", "created_by"),
    ("made by", "created_by"),
    ("authored by", "created_by"),
]

# --- fixed values: importance weight per entity type ---------------------------------------------------------------
TYPE_WEIGHTS = {
    "person": 0.8,
    "org": 0.7,
    "tech": 0.7,
    "code": 0.6,
    "api": 0.6,
    "concept": 0.5,
    "file_path": 0.4,
    "url": 0.3,
    "location": 0.5,
    "other": 0.3,
}

# --- fixed values: personal-data patterns, in redaction order: (label, severity, pattern) --------------------------
PII_PATTERNS = [
    (
        "API_KEY",
        "critical",
        r"(?:sk-[A-Za-z0-9]{20,}|sk-ant-[A-Za-z0-9\-]{20,}|AIza[A-Za-z0-9\-_]{35}|ghp_[A-Za-z0-9]{36}"
        r"|gho_[A-Za-z0-9]{36}|xoxb-[A-Za-z0-9\-]+|xoxp-[A-Za-z0-9\-]+|AKIA[A-Z0-9]{16}"
        r"|[A-Za-z0-9]{32,}_live_[A-Za-z0-9]+)",
    ),
    ("BEARER_TOKEN", "critical", r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*"),
    (
        "CREDIT_CARD",
        "high",
        r"(?U)\b(?:4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}|5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}"
        r"|3[47]\d{1}[-\s]?\d{6}[-\s]?\d{5}|6(?:011|5\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})\b",
    ),
    ("SSN", "high", r"(?U)\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("EMAIL", "medium", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    (
        "PHONE",
        "medium",
        r"(?U)(?<!\d)(?:\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}|\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})(?!\d)",
    ),
    (
        "IP_ADDRESS",
        "low",
        r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    ),
]

# What a text must hold for a pattern above to match: a plainer pattern that finds every such text, and perhaps others.
PII_NEEDS = {
    "API_KEY": r"sk-|AIza|gh[po]_|xox[bp]-|AKIA|_live_",
    "BEARER_TOKEN": r"[Bb][Ee][Aa][Rr][Ee][Rr]",
    "CREDIT_CARD": r"(?U)[3-6]\d\d",
    "SSN": r"(?U)\d{3}[-\s]?\d{2}[-\s]?\d{4}",
    "EMAIL": r"@",
    "PHONE": r"(?U)\d(?:\)?[-.\s]?\(?\d){3}",
    "IP_ADDRESS": r"(?U)\d\.\d",
}

# --- fixed values: prompt-injection patterns: (description, severity, case-insensitive pattern) ---------------------
INJECTION_PATTERNS = [
    ("System prompt override attempt", "high", r"(?i)ignore\s+(all\s+)?previous\s+instructions"),
    ("Instruction forgetting attempt", "high", r"(?i)forget\s+(all\s+)?your\s+(previous\s+)?instructions"),
    ("Jailbreak persona injection", "critical", r"(?i)you\s+are\s+now\s+(?:DAN|a\s+new\s+AI|unrestricted)"),
    ("Privilege escalation attempt", "high", r"(?i)(?:developer|debug|admin|god)\s+mode"),
    ("System prompt injection via role prefix", "high", r"(?i)system\s*:\s*you\s+are"),
    ("Base64-encoded instruction injection", "medium", r"(?i)base64\s*:\s*[A-Za-z0-9+/]{20,}={0,2}"),
    ("Chat ML delimiter injection", "critical", r"(?i)<\|(?:im_start|im_end|system|endoftext)\|>"),
    ("LLaMA instruction delimiter injection", "high", r"(?i)\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"),
]

# --- fixed values: security policies --------------------------------------------------------------------------------
POLICY_COLUMNS = (
    "policy string, redact_pii boolean, detect_injections boolean, block_on_critical boolean, encrypt_at_rest boolean,"
    " retention_days int, audit_logging boolean, audit_detail_level string, require_mfa boolean, dlp_enabled boolean,"
    " max_context_size_bytes bigint"
)
POLICIES = [
    ("default", True, True, False, True, 30, True, "basic", False, False, 10_000_000),
    ("strict", True, True, True, True, 90, True, "detailed", True, False, 10_000_000),
    ("enterprise", True, True, True, True, 365, True, "full", True, True, 50_000_000),
]
SUBSCRIPTION_POLICY = {"free": "default", "pro": "strict", "team": "strict", "enterprise": "enterprise"}

# --- fixed values: opposing technology choices (left side words, right side words) ----------------------------------
OPPOSING_CHOICES = [
    (["rest", "restful"], ["graphql"]),
    (["sql", "postgresql", "postgres", "mysql", "sqlite"], ["nosql", "mongodb", "dynamodb", "cassandra"]),
    (["monolith", "monolithic"], ["microservice", "microservices"]),
    (["aws", "amazon"], ["gcp", "google cloud"]),
    (["aws", "amazon"], ["azure", "microsoft cloud"]),
    (["gcp", "google cloud"], ["azure", "microsoft cloud"]),
    (["react"], ["vue", "vuejs"]),
    (["react"], ["angular"]),
    (["vue", "vuejs"], ["angular"]),
    (["typescript"], ["javascript"]),
    (["python"], ["go", "golang"]),
    (["docker"], ["podman"]),
    (["kubernetes", "k8s"], ["ecs", "fargate"]),
    (["serverless", "lambda"], ["containers", "kubernetes", "k8s"]),
    (["jwt"], ["session", "cookie"]),
    (["ssr"], ["spa", "csr"]),
]

# --- fixed values: subscription tiers (-1 = unlimited) ---------------------------------------------------------------
TIER_COLUMNS = (
    "tier string, display_name string, tier_rank int, monthly_price_usd double, annual_price_usd double,"
    " requests_per_hour int, burst_size int, shifts bigint, active_sessions bigint, brain_queries bigint,"
    " tokens_processed bigint, retention_days int, auto_captures bigint, chain_steps int, consensus_models int,"
    " consensus_trials bigint, team_seats int, api_keys int, webhooks int, file_upload_mb int, cockpit_enabled boolean,"
    " smart_dispatch boolean, digest_daily boolean, knowledge_gap_alerts boolean, analytics_enabled boolean,"
    " analytics_full boolean, sso_enabled boolean, team_roles_full_rbac boolean, reverse_trial_days int,"
    " support_level string, support_response_hours int"
)
TIERS = [
    ("free", "Free", 0, 0.0, 0.0, 30, 10, 10, 5, 15, 1_000_000, 30, 0, 0, 0, 1, 0, 0, 0, 5,
     False, False, False, False, False, False, False, False, 7, "community", 0),
    ("pro", "Pro", 1, 16.0, 144.0, 600, 50, -1, -1, -1, 5_000_000, 180, -1, 5, 0, 0, 4, 2, 3, 25,
     True, True, True, True, True, False, False, False, 0, "email", 48),
    ("pro_team", "Pro Team", 2, 14.0, 108.0, 2000, 200, -1, -1, -1, 10_000_000, -1, -1, 10, 4, 0, 5, 5, 10, 100,
     True, True, True, True, True, True, True, True, 0, "priority", 24),
    ("enterprise", "Enterprise", 3, 0.0, 0.0, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, 0, -1, 25, -1, 500,
     True, True, True, True, True, True, True, True, 0, "dedicated", 4),
]
TIER_FEATURES = """
cockpit_enabled smart_dispatch digest_daily knowledge_gap_alerts analytics_enabled analytics_full sso_enabled
team_roles_full_rbac
""".split()

# --- fixed values: call prices, USD per 1M tokens: (model, prompt, completion) ----------------------------------------
CALL_PRICES = [
    ("openai/gpt-4o", 2.50, 10.00),
    ("openai/gpt-4o-mini", 0.15, 0.60),
    ("anthropic/claude-sonnet-4", 3.00, 15.00),
    ("anthropic/claude-haiku-4", 0.80, 4.00),
    ("google/gemini-2.0-flash", 0.10, 0.40),
    ("google/gemini-2.5-pro", 1.25, 10.00),
]

# --- fixed values: model registry: (model, provider, prompt price, completion price, context window) -----------------
MODEL_REGISTRY = [
    ("gpt-4o", "openai", 2.50, 10.00, 128_000),
    ("gpt-4o-mini", "openai", 0.15, 0.60, 128_000),
    ("gpt-4.1", "openai", 2.00, 8.00, 1_000_000),
    ("gpt-4.1-mini", "openai", 0.40, 1.60, 1_000_000),
    ("claude-sonnet-4", "anthropic", 3.00, 15.00, 200_000),
    ("claude-haiku-4", "anthropic", 0.80, 4.00, 200_000),
    ("claude-opus-4", "anthropic", 15.00, 75.00, 200_000),
    ("gemini-2.0-flash", "google", 0.10, 0.40, 1_000_000),
    ("gemini-2.5-pro", "google", 1.25, 10.00, 1_000_000),
]

# --- fixed values: words that classify a task, in class order ----------------------------------------------------------
TASK_KEYWORDS = [
    (
        "coding",
        "code implement function class api endpoint debug fix bug test refactor build deploy python javascript"
        " typescript rust go sql database migration schema rest graphql",
    ),
    (
        "creative",
        "write story poem creative brainstorm idea design name brand slogan marketing content blog article copy headline",
    ),
    (
        "analysis",
        "analyze compare evaluate pros cons tradeoff benchmark performance metrics data statistics research review"
        " assess audit",
    ),
    (
        "explanation",
        "explain how why what tutorial guide teach learn understand concept overview documentation docs",
    ),
]

# --- fixed values: suitability of a model per task class ----------------------------------------------------------------
MODEL_SCORES = [
    ("anthropic/claude-sonnet-4", "coding", 0.95),
    ("anthropic/claude-sonnet-4", "creative", 0.80),
    ("anthropic/claude-sonnet-4", "analysis", 0.90),
    ("anthropic/claude-sonnet-4", "explanation", 0.90),
    ("anthropic/claude-sonnet-4", "general", 0.90),
    ("openai/gpt-4o", "coding", 0.88),
    ("openai/gpt-4o", "creative", 0.90),
    ("openai/gpt-4o", "analysis", 0.85),
    ("openai/gpt-4o", "explanation", 0.88),
    ("openai/gpt-4o", "general", 0.88),
    ("google/gemini-2.5-pro", "coding", 0.85),
    ("google/gemini-2.5-pro", "creative", 0.75),
    ("google/gemini-2.5-pro", "analysis", 0.92),
    ("google/gemini-2.5-pro", "explanation", 0.85),
    ("google/gemini-2.5-pro", "general", 0.85),
    ("openai/gpt-4o-mini", "coding", 0.70),
    ("openai/gpt-4o-mini", "creative", 0.75),
    ("openai/gpt-4o-mini", "analysis", 0.65),
    ("openai/gpt-4o-mini", "explanation", 0.72),
    ("openai/gpt-4o-mini", "general", 0.72),
]

# --- fixed values: provider labels ---------------------------------------------------------------------------------------
FORMAT_PROVIDER = {
    "openai": "openai",
    "openai_export": "openai",
    "claude": "anthropic",
    "gemini": "google",
    "generic": "unknown",
    "unknown": "unknown",
}
PLATFORM_PROVIDER = {"chatgpt": "openai", "claude": "anthropic", "gemini": "google"}

# --- fixed values: role markers of plain-text transcripts ---------------------------------------------------------------
TURN_MARKER_WORDS = [
    ("system", "system instruction instructions"),
    ("user", "user human me q you person customer"),
    ("assistant", "assistant ai bot claude gpt chatgpt gemini copilot model a response answer"),
]
