"""The stored tables.  Schemas are explicit everywhere; nothing is inferred."""

FILES = "path string, modificationTime timestamp, length long, content binary"
PREPROCESSED = "fingerprint string, path string, text string"
EXTRACTED = "datasets_used boolean, datasets array<struct<title:string,description:string,task_description:string,link:string,task:array<string>>>"
EXTRACTIONS = f"fingerprint string, {EXTRACTED}"
DOCUMENTS = "id string"
DATASETS = "id string, document_id string, title string, description string, link string"
TASKS = "id string, dataset_id string, task_description string, keywords array<string>"
VECTORS = "hex_id string, int64_id long, text string, embedding array<float>"
NODES = "id string, type string, aliases array<string>"
EDGES = "src string, dst string, type string, weight double"
ALIASES = "key string, target string"
DIFFERENT = "lo string, hi string"
BENCHMARK = "task string, ground_truth string, link string"
