"""What a machine says of itself, and the settings file."""

from __future__ import annotations

import os
import platform
import secrets
import shutil
import socket
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.paths import mac_address, thumbprint
from arborlake.sources.snapshots import DEVICE


def os_release(text: str) -> dict[str, str]:
    """``key=value`` lines without comments, blanks and quotes."""
    pairs = (line.strip().partition("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#") and "=" in line)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def memory_size() -> int | None:
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return None


def storage_space(path: str = "/") -> int | None:
    try:
        return shutil.disk_usage(path).total
    except OSError:
        return None


def system_info(spark: SparkSession) -> DataFrame:
    """One device row of this machine."""
    release = Path("/etc/os-release")
    row = {"device_name": socket.gethostname(), "device_type": "PC", "host_name": socket.gethostname(), "cpu_model": platform.processor(), "os_name": platform.system(), "os_version": platform.version(), "os_release": platform.release(), "device_model": platform.machine(), "memory_size": memory_size(), "storage_space": storage_space(), "freedesktop_os_release": os_release(release.read_text()) if release.exists() else {}}
    try:
        row["ip_addr"] = socket.gethostbyname(row["host_name"])
    except OSError:
        row["ip_addr"] = None
    df = spark.createDataFrame([row], DEVICE).withColumn("mac_addr", mac_address(F.lit(uuid.getnode())))
    parts = [F.col(c) for c in ("host_name", "device_model", "cpu_model", "os_name", "os_release")]
    return df.withColumn("thumbprint", thumbprint(*parts, F.lit(uuid.getnode())))  # the address as a decimal number


@dataclass
class Settings:
    data_path: str = "./data"
    backup_path: str = "./backups"
    login_password: str = ""
    require_password: bool = True

    @classmethod
    def read(cls, *paths: str) -> Settings:
        """The first file that exists, of ``key: value`` lines; unknown keys and broken lines are left out."""
        out = cls()
        for path in map(Path, paths):
            if path.exists():
                for line in path.read_text().splitlines():
                    key, _, value = line.partition(":")
                    key, value = key.strip(), value.strip().strip("\"'")
                    if key == "require_password":
                        out.require_password = value.lower() in ("true", "yes", "on", "1")
                    elif hasattr(out, key):
                        setattr(out, key, value)
                break
        return out

    def write(self, path: str) -> None:
        """With a fresh password if there is none."""
        self.login_password = self.login_password or secrets.token_urlsafe(12)
        Path(path).write_text("".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in self.__dict__.items()))
