"""Catalogue of message parsers: 14 with field moves, the rest parse JSON only."""

from __future__ import annotations

from skyledger.operators.parse import Parser

# Datasets whose parser only reads JSON into ``<suffix>.parsed``, by group.
JSON_ONLY = {
    "aiml": (
        "kendra a2i healthlake nova lookoutvision healthomics bedrockdataautomation "
        "sagemakerfeaturestore sagemakerpipelines sagemakermodelmonitor lookoutequipment monitron"
    ),
    "analytics": (
        "lakeformation quicksight databrew appflow opensearch mwaa cleanrooms datazone "
        "entityresolution dataexchange appfabric b2bi"
    ),
    "compute": (
        "ec2_logs eks ecr batch elasticbeanstalk autoscaling imagebuilder outposts wavelength m2 "
        "pcs evs simspaceweaver"
    ),
    "databases": (
        "elasticache aurora docdb neptune timestream qldb keyspaces memorydb dax neptuneanalytics "
        "auroradsql rdsproxy rdscustom dmsserverless elasticacheglobal"
    ),
    "devtools": (
        "codedeploy codecommit codeartifact amplify xray codeguru codecatalyst devicefarm proton "
        "qdeveloper cloudshell cloud9 robomaker"
    ),
    "enduser": (
        "workspaces connect appstream gamelift ses pinpoint transfer lightsail frauddetector "
        "location mediaconvert medialive blockchain devopsguru workmail wickr"
    ),
    "iot": (
        "greengrass iotanalytics iotdefender iotevents iotsitewise iottwinmaker iotfleetwise "
        "groundstation kinesisvideo panorama freertos"
    ),
    "management": (
        "cloudwatch trustedadvisor controltower organizations servicecatalog servicequotas "
        "computeoptimizer budgets ram resiliencehub migrationhub networkmanager dms fis "
        "managedgrafana supplychain arc appconfig drs licensemanager chatbot cloudwatch_rum"
    ),
    "media": "deadlinecloud chimesdkvoice",
    "ml": (
        "bedrock rekognition textract comprehend comprehendmedical translate transcribe polly "
        "forecast personalize lex lookoutmetrics"
    ),
    "networking": (
        "shield globalaccelerator directconnect privatelink wafv2 vpclattice appmesh clientvpn "
        "cloudmap vpcipam private5g"
    ),
    "security": (
        "macie accessanalyzer cognito kms secretsmanager acm identitycenter detective securityir "
        "cloudhsm auditmanager verifiedpermissions paymentcryptography artifact "
        "networkaccessanalyzer incidentmanager"
    ),
    "serverless": "stepfunctions apprunner appsync fargate",
    "storage": (
        "s3storagelens efs fsx backup datasync storagegateway s3_intelligent_tiering "
        "s3_batch_operations"
    ),
    "streaming": "firehose kinesisanalytics amazonmq eventbridge mskconnect endusermessaging",
}
# Fixed value: the one namespace that is not the dataset suffix.
NAMESPACES = {"ec2_logs": "ec2"}

# Function log lines, most specific first. Separators are tabs or spaces.
FUNCTION_LINES = (
    r"REPORT RequestId: %{DATA:lambda.requestId}\s+Duration: %{NUMBER:lambda.durationMs:float} ms"
    r"\s+Billed Duration: %{NUMBER:lambda.billedDurationMs:float} ms"
    r"\s+Memory Size: %{NUMBER:lambda.memorySizeMB:int} MB"
    r"\s+Max Memory Used: %{NUMBER:lambda.maxMemoryUsedMB:int} MB",
    r"START RequestId: %{DATA:lambda.requestId}\s+Version: %{DATA:lambda.version}",
    r"END RequestId: %{DATA:lambda.requestId}",
)


def _moves(suffix: str, group: str, keys: str, renamed: dict[str, str] | None = None) -> Parser:
    """A parser whose keys move to ``<suffix>.<key>``, or to a shared field where named."""
    renamed = renamed or {}
    space = NAMESPACES.get(suffix, suffix.removesuffix("_logs"))
    pairs = tuple((k, renamed.get(k, f"{space}.{k}")) for k in keys.split())
    lower = tuple(t for _, t in pairs if t == "log.level")
    return Parser(f"aws.{suffix}", group, f"{space}.parsed", pairs, lower)


# Keys moved out of the parsed JSON.
WITH_MOVES = [
    _moves("glue", "analytics", "jobName jobRunId level errorCode",
           {"level": "log.level", "errorCode": "error.code"}),
    _moves("emr_logs", "analytics", "logLevel clusterId applicationId containerId component",
           {"logLevel": "log.level"}),
    _moves("athena", "analytics",
           "queryId workgroup database state durationSeconds dataScannedBytes"),
    _moves("sagemaker", "ml", "level event space appType user", {"level": "log.level"}),
    _moves("qbusiness", "ml", "event_type application_id conversation_id guardrail_action"),
    Parser("aws.lambda_logs", "serverless", "lambda.parsed", groks=FUNCTION_LINES),
    _moves("rds", "databases", "level thread logger", {"level": "log.level"}),
    _moves("verifiedaccess", "security", "verdict deny_reason device_posture trust_provider_type"),
    _moves("securitylake", "security",
           "class_uid category_uid activity_id severity_id class_name"),
    _moves("iot", "iot", "clientId action topic"),
    _moves("cloudformation", "management", "stackName stackStatus action"),
    _moves("ssm", "management", "commandId documentName instanceId status"),
    _moves("codebuild", "management", "buildId project phase status"),
    _moves("codepipeline", "management", "pipeline executionId stage state"),
]


def all_parsers() -> list[Parser]:
    plain = [
        Parser(f"aws.{s}", group, f"{NAMESPACES.get(s, s)}.parsed")
        for group, names in JSON_ONLY.items()
        for s in names.split()
    ]
    return WITH_MOVES + plain


def parsers_of(groups: list[str] | None = None) -> list[Parser]:
    """the parsers of the chosen groups; all when no group is named."""
    return [p for p in all_parsers() if not groups or p.group in groups]


def group_names() -> list[str]:
    """Distinct group names in order."""
    return sorted({p.group for p in all_parsers()})
