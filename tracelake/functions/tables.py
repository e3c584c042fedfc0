"""Code tables. All names and texts here are fixed values: results must show exactly these."""

# Messages of error numbers, 0 to 106 in order, then the negative ones.
ERRNO = dict(
    enumerate(
        """Success
Operation not permitted
No such file or directory
No such process
Interrupted system call
Input/Output error
Device not configured
Argument list too long
Exec format error
Bad file descriptor
No child processes
Resource deadlock avoided
Cannot allocate memory
Permission denied
Bad address
Block device required
Device / Resource busy
File exists
Cross-device link
Operation not supported by device
Not a directory
Is a directory
Invalid arguement
Too many open files in system
Too many open files
Inappropriate ioctl for devices
Text file busy
File too large
No space left on device
Illegal seek
Read-only filesystem
Too many link
Broken pipe
Numerical argument out of domain
Result too large
Resource temporarily unavailable, operation would block
Operation now in progress
Operation already in progress
Socket operation on non-socket
Destination address required
Message too long
Protocol wrong type for socket
Protocol not available
Protocol not supported
Socket type not supported
Operation not supported, Operation not supported on socket
Protocol family not supported
Address family not supported by protocol family
Address already in use
Can't assign requested address
Network is down
Network is unreachable
Network dropped connection on reset
Software caused connection abort
Connection reset by peer
No buffer space available
Socket is already connected
Socket is not connected
Can't send after socket shutdown
Too many references: can't splice
Operation timed out
Connection refused
Too many levels of symbolic links
File name too long
Host is down
No route to host
Directory not empty
Too many processes
Too many users
Disc quota exceeded
Stale NFS file handle
Too many levels of remote in path
RPC struct is bad
RPC version wrong
RPC prog. not avail
Program version wrong
Bad procedure for program
No locks available
Function not implemented
Inappropriate file type or format
Authentication error
Need authenticator
Device power is off
Device error, e.g. paper out
Value too large to be stored in data type
Bad executable
Bad CPU type in executable
Shared library version mismatch
Malformed Macho file
Operation canceled
Identifier removed
No message of desired type
Illegal byte sequence
Attribute not found
Bad message
Reserved
No message available on STREAM
Reserved
No STREAM resources
Not a STREAM
Protocol error
STREAM ioctl timeout
Operation not supported on socket
No such policy registered
State not recoverable
Previous owner died
Interface output queue is full, Must be equal largest errno""".split("\n")
    )
) | {
    -1: "Restart syscall",
    -2: "Don't modify regs, just return",
    -5: "Restart lookup under heavy vnode pressure/recycling",
    -6: "Red drive open",
    -7: "Keep looking",
    -8: "Data less",
}

# Kernel message-passing errors.
MACH_ERRNO = {
    268435459: "(ipc/send) invalid destination port",
    268435460: "timed out",
    268435461: "invalid voucher",
    268435464: "message too small",
    268435465: "invalid reply",
    268435466: "invalid right",
    268435467: "invalid notify",
    268435468: "invalid memory",
    268435469: "no buffer",
    268435470: "too large",
    268435471: "invalid type",
    268435472: "invalid header",
    268435473: "invalid trailer",
    4294967644: "invalid rt ool size",
}

# One permission digit.
MODE = {"1": "--x", "2": "-w-", "3": "-wx", "4": "r--", "5": "r-x", "6": "rw-", "7": "rwx"}

# Directory-service errors.
OD_ERROR = {
    0: "ODErrorSuccess",
    2: "Not Found",
    1000: "ODErrorSessionLocalOnlyDaemonInUse",
    1001: "ODErrorSessionNormalDaemonInUse",
    1002: "ODErrorSessionDaemonNotRunning",
    1003: "ODErrorSessionDaemonRefused",
    1100: "ODErrorSessionProxyCommunicationError",
    1101: "ODErrorSessionProxyVersionMismatch",
    1102: "ODErrorSessionProxyIPUnreachable",
    1103: "ODErrorSessionProxyUnknownHost",
    2000: "ODErrorNodeUnknownName",
    2001: "ODErrorNodeUnknownType",
    2002: "ODErrorNodeDisabled",
    2100: "ODErrorNodeConnectionFailed",
    2200: "ODErrorNodeUnknownHost",
    3000: "ODErrorQuerySynchronize",
    3100: "ODErrorQueryInvalidMatchType",
    3101: "ODErrorQueryUnsupportedMatchType",
    3102: "ODErrorQueryTimeout",
    4000: "ODErrorRecordReadOnlyNode",
    4001: "ODErrorRecordPermissionError",
    4100: "ODErrorRecordParameterError",
    4101: "ODErrorRecordInvalidType",
    4102: "ODErrorRecordAlreadyExists",
    4103: "ODErrorRecordTypeDisabled",
    4104: "ODErrorRecordNoLongerExists",
    4200: "ODErrorRecordAttributeUnknownType",
    4201: "ODErrorRecordAttributeNotFound",
    4202: "ODErrorRecordAttributeValueSchemaError",
    4203: "ODErrorRecordAttributeValueNotFound",
    5000: "ODErrorCredentialsInvalid",
    5001: "ODErrorCredentialsInvalidComputer",
    5100: "ODErrorCredentialsMethodNotSupported",
    5101: "ODErrorCredentialsNotAuthorized",
    5102: "ODErrorCredentialsParameterError",
    5103: "ODErrorCredentialsOperationFailed",
    5200: "ODErrorCredentialsServerUnreachable",
    5201: "ODErrorCredentialsServerNotFound",
    5202: "ODErrorCredentialsServerError",
    5203: "ODErrorCredentialsServerTimeout",
    5204: "ODErrorCredentialsContactPrimary",
    5205: "ODErrorCredentialsServerCommunicationError",
    5300: "ODErrorCredentialsAccountNotFound",
    5301: "ODErrorCredentialsAccountDisabled",
    5302: "ODErrorCredentialsAccountExpired",
    5303: "ODErrorCredentialsAccountInactive",
    5304: "ODErrorCredentialsAccountTemporarilyLocked",
    5305: "ODErrorCredentialsAccountLocked",
    5400: "ODErrorCredentialsPasswordExpired",
    5401: "ODErrorCredentialsPasswordChangeRequired",
    5402: "ODErrorCredentialsPasswordQualityFailed",
    5403: "ODErrorCredentialsPasswordTooShort",
    5404: "ODErrorCredentialsPasswordTooLong",
    5405: "ODErrorCredentialsPasswordNeedsLetter",
    5406: "ODErrorCredentialsPasswordNeedsDigit",
    5407: "ODErrorCredentialsPasswordChangeTooSoon",
    5408: "ODErrorCredentialsPasswordUnrecoverable",
    5500: "ODErrorCredentialsInvalidLogonHours",
    6000: "ODErrorPolicyUnsupported",
    6001: "ODErrorPolicyOutOfRange",
    10000: "ODErrorPluginOperationNotSupported",
    10001: "ODErrorPluginError",
    10002: "ODErrorDaemonError",
    10003: "ODErrorPluginOperationTimeout",
}

# Kinds of directory members.
OD_MEMBER = {0: "UID", 1: "GID", 3: "SID", 4: "USERNAME", 5: "GROUPNAME", 6: "UUID", 7: "GROUP NFS", 8: "USER NFS", 10: "GSS EXPORT NAME", 11: "X509 DN", 12: "KERBEROS"}

# Location service codes.
LOCATION_AUTHORIZATION = {0: "Not Determined", 1: "Restricted", 2: "Denied", 3: "Authorized Always", 4: "Authorized When In Use"}
LOCATION_DAEMON = {0: "Reachability Unavailable", 1: "Reachability Small", 2: "Reachability Large", 56: "Reachability Unachievable"}
LOCATION_HARVESTER = dict(enumerate("CellLegacy Cell Wifi Tracks Realtime App Pass Indoor Pressure Poi Trace Avenger Altimeter Ionosphere Unknown".split()))
LOCATION_IO = {
    3758096400: "ServiceIsTerminated",
    3758096416: "ServiceIsSuspended",
    3758096432: "ServiceIsResumed",
    3758096640: "ServiceIsRequestingClose",
    3758096641: "ServiceIsAttemptingOpen",
    3758096656: "ServiceWasClosed",
    3758096672: "ServiceBusyStateChange",
    3758096680: "ConsoleSecurityChange",
    3758096688: "ServicePropertyChange",
    3758096896: "CanDevicePowerOff",
    3758096912: "DeviceWillPowerOff",
    3758096928: "DeviceWillNotPowerOff",
    3758096944: "DeviceHasPoweredOn",
    3758096976: "SystemWillPowerOff",
    3758096981: "SystemPagingOff",
    3758097008: "CanSystemSleep",
    3758097024: "SystemWillSleep",
    3758097040: "SystemWillNotSleep",
    3758097152: "SystemHasPoweredOn",
    3758097168: "SystemWillRestart",
    3758097184: "SystemWillPowerOn",
    3758097200: "CopyClientID",
    3758097216: "SystemCapabilityChange",
    3758097232: "DeviceSignaledWakeup",
}
SQLITE = dict(
    enumerate(
        "SQLITE " + name
        for name in "OK,ERROR,INTERNAL,PERM,ABORT,BUSY,LOCKED,NOMEM,READ ONLY,INTERRUPT,IO ERR,CORRUPT,NOT FOUND,FULL,CAN'T OPEN,PROTOCOL,EMPTY,SCHEMA,TOO BIG,CONSTRAINT,MISMATCH,MISUSE,NO LFS,AUTH,FORMAT,RANGE,NOT A DB,NOTICE,WARNING".split(",")
    )
) | {100: "SQLITE ROW", 101: "SQLITE DONE", 266: "SQLITE IO ERR READ"}
REACHABILITY = {0: "kReachabilityUnavailable", 1: "kReachabilitySmall", 2: "kReachabilityLarge", 1000: "kReachabilityUnachievable"}
CHARGER = {0: "kChargerTypeUnknown", 2: "kChargerTypeUsb"}

# Name-service codes.
DNS_TYPE = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY",
    28: "AAAA", 29: "LOC", 33: "SRV", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG",
    47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 59: "CDS", 60: "CDNSKEY",
    61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG", 255: "ANY",
    256: "URI", 257: "CAA", 32768: "TA", 32769: "DLV",
}
DNS_REASON = {1: "no-data", 2: "nxdomain", 3: "no-dns-service", 4: "query-suppressed", 5: "server error"}
DNS_PROTOCOL = {1: "UDP", 2: "TCP", 4: "HTTPS"}
DNS_OPTIONS = {0: "0x0 {}", 8: "0x8 {use-failover}", 12: "0xC {in-app-browser, use-failover}", 24: "0x18 {use-failover, prohibit-encrypted-dns}"}
DNS_OPCODE = dict(enumerate(["QUERY", "IQUERY", "STATUS", "RESERVED", "NOTIFY", "UPDATE"]))
DNS_RCODE = dict(enumerate(["No Error", "Format Error", "Server Failure", "NX Domain", "Not Implemented", "Refused", "YX Domain", "YX RR Set", "NX RR Set", "Not Auth", "Not Zone"]))

# Classes of events and logs.
EVENT_TYPE = {2: "Activity", 3: "Trace", 4: "Log", 6: "Signpost", 7: "Loss"}
LOG_TYPE = {
    2: "Debug", 3: "Useraction", 0x10: "Error", 0x11: "Fault",
    0x80: "ProcessSignpostEvent", 0x81: "ProcessSignpostStart", 0x82: "ProcessSignpostEnd",
    0xC0: "SystemSignpostEvent", 0xC1: "SystemSignpostStart", 0xC2: "SystemSignpostEnd",
    0x40: "ThreadSignpostEvent", 0x41: "ThreadSignpostStart", 0x42: "ThreadSignpostEnd",
}

# What stands in a result where something could not be had.
UNKNOWN_SUBSYSTEM, MISSING, PRIVATE, NULL_TEXT = "Unknown subsystem", "<Missing message data>", "<private>", "(null)"

# What a failed read is called.
ERRORS = {
    "path": "Failed to open file path",
    "dir": "Failed to open directory path",
    "TraceV3": "Failed to parse tracev3 file",
    "read": "Failed to read file",
    "Timesync": "Failed to parse timesync file",
    "Dsc": "Failed to parse dsc file",
    "UUIDText": "Failedto parse UUIDtext file",
}
