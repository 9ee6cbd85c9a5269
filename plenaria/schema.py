"""Record schemas and domain constants."""

from __future__ import annotations


SPEECH_DDL = (
    "country string, parliament string, chamber string, date string, session_id string, speech_id string, speaker_id string, speaker_name string, "
    "speech_text string, source_url string, party string, speaker_role string, legislative_term string, source_type string, source_identifier string, "
    "raw_text string, cleaning_notes string, text_language string, record_status string, word_count int"
)
SPEECH_COLUMNS = [part.split()[0] for part in SPEECH_DDL.split(", ")]
REQUIRED = ("country", "parliament", "chamber", "date", "session_id", "speech_id", "speaker_name", "speech_text", "source_url")
RESPONSE_DDL = (
    "speech_id string, stage string, version string, fraction_ai double, fraction_ai_assisted double, fraction_human double, prediction_short string, "
    "mock boolean, error string, windows array<struct<label:string,word_count:int>>"
)
STATE_DDL = "fingerprint string, status string, task_id string, error string, response string"
MANIFEST_DDL = (
    "source_url string, retrieved_at_utc string, local_path string, bytes bigint, sha256 string, content_type string, http_status int, "
    "retrieved_at_utc_basis string, provenance_status string"
)
UNKNOWN = "__UNKNOWN__"
YEARS = (2018, 2025)

# Markers of roles (casefolded).
MINISTER_MARKERS = (
    "minist", "kanzler", "premier", "secrétaire d'état", "secretaire d'etat", "staatssecretaris", "garde des sceaux",
    "presidente del consiglio", "sottosegretari",
)
CHAIR_TOKEN = "presiding_officer"
HEAD_OF_STATE_GOVERNMENT = "ministerpräsident"
CHAIR_ROLE_MARKERS = ("präsident", "praeses", "marszał", "presiding")
CHAIR_NAME_PREFIXES = ("marszałek", "wicemarszałek")
CHAIR_NAME_MARKERS = ("le président", "la présidente", "président de la séance", "presidente de la mesa", "presidente de la cámara")
# Window labels after normalisation.
AI_LABELS = ("ai-generated", "ai-written", "ai", "generated-by-ai", "machine-generated", "ai-text", "ai-generated-text")
MIXED_LABELS = ("ai-assisted", "mixed", "ai-assisted-mixed", "ai-assisted-and-mixed", "mixed-ai-human")
HUMAN_LABELS = ("human-written", "human", "human-text", "human-generated", "non-ai", "not-ai", "not-ai-written")
# Languages and parliaments of the countries.
LANGUAGE = {"Germany": "de", "France": "fr", "Netherlands": "nl", "Italy": "it", "Spain": "es", "Poland": "pl"}
PARLIAMENT = {
    "Germany": "Bundestag", "France": "Assemblée nationale", "Netherlands": "Tweede Kamer", "Italy": "Camera dei deputati",
    "Spain": "Congreso de los Diputados", "Poland": "Sejm",
}
MISSING_IDS = ("0", "unknown", "none", "null", "n/a")
