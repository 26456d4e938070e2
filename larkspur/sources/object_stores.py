"""Storage options of object stores, as Hadoop settings; paths by scheme."""

from __future__ import annotations

from urllib.parse import urlparse

#: This engine's option -> the connector's key.
_S3 = {"aws.access_key_id": "fs.s3a.access.key", "aws.secret_access_key": "fs.s3a.secret.key", "aws.session_token": "fs.s3a.session.token", "aws.region": "fs.s3a.endpoint.region", "aws.endpoint": "fs.s3a.endpoint"}
_GCS = {"gcp.service_account_path": "fs.gs.auth.service.account.json.keyfile", "gcp.service_account_key": "fs.gs.auth.service.account.private.key", "gcp.application_credentials_path": "fs.gs.auth.service.account.json.keyfile"}
_SCHEMES = {"s3": "s3a", "s3a": "s3a", "oss": "oss", "cos": "cosn", "cosn": "cosn", "gs": "gs", "gcs": "gs"}
_CHAIN = "com.amazonaws.auth.DefaultAWSCredentialsProviderChain"


def hadoop_path(path: str) -> str:
    """The path under the scheme of the Hadoop connector."""
    scheme = urlparse(path).scheme
    return _SCHEMES[scheme] + path[len(scheme) :] if scheme in _SCHEMES else path


def hadoop_options(path: str, options: dict[str, str] | None) -> dict[str, str]:
    """Hadoop settings for a path; unknown options are refused."""
    options = dict(options or {})
    scheme = urlparse(path).scheme
    if scheme in ("s3", "s3a"):
        allow_http = str(options.pop("aws.allow_http", "false")).lower() == "true"
        endpoint = options.get("aws.endpoint", "")
        if endpoint.startswith("http://") and not allow_http:
            raise ValueError("Invalid endpoint: http is not allowed for OSS/S3 unless aws.allow_http is set")
        out = _translate(options, _S3)
        if "fs.s3a.access.key" in out and "fs.s3a.secret.key" in out:
            kind = "TemporaryAWSCredentialsProvider" if "fs.s3a.session.token" in out else "SimpleAWSCredentialsProvider"
            out["fs.s3a.aws.credentials.provider"] = f"org.apache.hadoop.fs.s3a.{kind}"
        else:
            out["fs.s3a.aws.credentials.provider"] = _CHAIN
        if allow_http:
            out["fs.s3a.connection.ssl.enabled"] = str(not endpoint.startswith("http://")).lower()
        return out
    if scheme in ("gs", "gcs"):
        out = _translate(options, _GCS)
        out["fs.gs.auth.type"] = "SERVICE_ACCOUNT_JSON_KEYFILE" if options else "APPLICATION_DEFAULT"
        return out
    if scheme in ("oss", "cos", "cosn"):
        prefix = "fs.oss" if scheme == "oss" else "fs.cosn.userinfo"
        names = {"oss": ("accessKeyId", "accessKeySecret", "endpoint")}.get(scheme, ("secretId", "secretKey", "endpoint"))
        table = dict(zip(("aws.access_key_id", "aws.secret_access_key", f"aws.{scheme[:3]}.endpoint"), (f"{prefix}.{n}" for n in names)))
        options.pop("aws.region", None)
        return _translate(options, {**table, "aws.endpoint": f"{prefix}.endpoint"})
    if options:
        raise ValueError(f"{scheme or 'local'} paths take no storage options")
    return {}


def _translate(options: dict[str, str], table: dict[str, str]) -> dict[str, str]:
    unknown = [k for k in options if k not in table]
    if unknown:
        raise ValueError(f"unknown storage options: {', '.join(sorted(unknown))}")
    return {table[k]: v for k, v in options.items()}
