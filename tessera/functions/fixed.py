"""Lists that must be the same wherever results are to agree."""

from __future__ import annotations

# Directories an index never takes up (hidden ones fall to the rule for hidden names as well).
SKIPPED_DIRS = ["node_modules", "vendor", ".venv", "venv", "__pycache__", "target", ".tox", ".mypy_cache", ".pytest_cache", "Pods", ".gradle", ".cargo"]

# Generators with the file names and header markers they are known by.
GENERATORS = [
    ("protobuf-gateway", ["*.pb.gw.go"], ["Code generated by protoc-gen-grpc-gateway"]),
    ("protobuf", ["*_grpc.pb.go", "*.pb.go"], ["Code generated by protoc-gen-go"]),
    ("wire", ["wire_gen.go"], ["Code generated by Wire"]),
    ("deepcopy", ["zz_generated.deepcopy.go"], ["//go:build !ignore_autogenerated"]),
    ("stringer", [], ['Code generated by "stringer"']),
    ("enumer", ["*_enumer.go"], ["Code generated by enumer"]),
    ("mockgen", ["mock_*.go", "*_mock.go"], ["Code generated by MockGen", "Code generated by mockery"]),
    ("sqlc", [], ["Code generated by sqlc"]),
    ("ent", [], ["Code generated by ent"]),
    ("gorm-gen", [], [r"Code generated by gorm\.io/gen"]),
    ("go-bindata", [], ["Code generated by go-bindata"]),
    ("go-generate", [], [r"(?m)^// Code generated .* DO NOT EDIT\.$"]),
    ("protobuf", ["*_pb2.py", "*_pb2_grpc.py", "*_pb2.pyi"], []),
    ("grpc", ["*_grpc.py"], ["Generated by the gRPC Python protocol compiler"]),
    ("django-migrations", [], ["Generated by Django"]),
    ("pydantic-codegen", [], ["generated by datamodel-code-generator"]),
    ("mypy-stubgen", [], ["# Stubs for", "automatically generated by mypy"]),
    ("protobuf", ["*_pb.js", "*_pb.ts", "*_pb.d.ts"], ["Generated by the protocol buffer compiler", "@generated from protobuf"]),
    ("graphql-codegen", ["*.generated.ts", "*.generated.tsx"], ["THIS FILE WAS GENERATED"]),
    ("swagger", ["*.swagger.json", "*.swagger.ts"], []),
    ("openapi", [], ["OpenAPI Generator"]),
    ("grpc", ["*Grpc.java"], [r"@javax\.annotation\.Generated"]),
    ("dagger", ["Dagger*.java", "*_Factory.java", "*_MembersInjector.java"], []),
    ("lombok", [], [r"@lombok\.Generated"]),
    ("jooq", [], ["jOOQ"]),
    ("annotation-processor", [], [r"@javax\.annotation\.processing\.Generated"]),
    ("protobuf", [], ["Generated by the protocol buffer compiler", "//! @generated by prost"]),
    ("bindgen", [], ["automatically generated by rust-bindgen"]),
    ("build-script", [], [r"automatically generated by build\.rs"]),
    ("protobuf", ["*.pb.h", "*.pb.cc", "*.pb.c"], ["Generated by the protocol buffer compiler"]),
    ("flex", ["lex.yy.c", "lex.*.c"], ["Generated by flex"]),
    ("bison", ["*.tab.c", "*.tab.h"], ["A Bison parser", "generated by GNU Bison"]),
    ("moc", ["moc_*.cpp"], ["generated by Meta Object Compiler"]),
    ("cmake", ["*Config.cmake", "*-config.cmake"], ["# Generated by CMake"]),
    ("thrift", [], ["Autogenerated by Thrift"]),
    ("protobuf", ["*_pb.rb"], ["Generated by the protocol buffer compiler"]),
    ("rails-migration", [], ["This file is auto-generated"]),
    ("auto-generated", ["*.designer.cs", "*.Designer.cs", "*.g.cs", "*.g.i.cs"], ["<auto-generated>"]),
    ("protobuf", [], ["Generated by the protocol buffer compiler"]),
    ("protobuf", ["*.pb.swift"], ["SwiftProtobuf", "protoc-gen-swift"]),
    ("coredata", ["*+CoreDataProperties.swift"], []),
    ("sourcery", [], ["Generated using Sourcery"]),
    ("unknown", [], ["@generated", "AUTO-GENERATED", "AUTOGENERATED", "This file is automatically generated", "(?i)generated.*DO NOT EDIT|DO NOT EDIT.*generated"]),
]

# Capabilities: name, technique, category, confidence, whether all calls are needed, the calls.
CAPABILITIES = [
    ("Encrypt/Decrypt Data", "T1027", "crypto", "high", False, "CryptEncrypt CryptDecrypt BCryptEncrypt BCryptDecrypt EVP_EncryptInit EVP_DecryptInit AES_encrypt AES_decrypt SHA256_Init SHA256_Update MD5_Init"),
    ("Network Communication", "T1071", "network", "high", False, "connect send recv WSAStartup WSASocket InternetOpenA InternetOpenW HttpSendRequestA HttpSendRequestW HttpOpenRequestA socket bind listen accept getaddrinfo gethostbyname"),
    ("Process Injection", "T1055", "process_injection", "high", True, "VirtualAllocEx WriteProcessMemory CreateRemoteThread"),
    ("Registry Persistence", "T1547", "persistence_registry", "medium", False, "RegSetValueExA RegSetValueExW RegCreateKeyExA RegCreateKeyExW"),
    ("Anti-Debug Checks", "T1622", "anti_debug", "high", False, "IsDebuggerPresent CheckRemoteDebuggerPresent NtQueryInformationProcess"),
    ("Dynamic API Resolution", "T1106", "dynamic_api", "medium", False, "GetProcAddress LoadLibraryA LoadLibraryW LdrLoadDll"),
    ("File Operations", "T1070", "file_ops", "low", False, "CreateFileA CreateFileW WriteFile DeleteFileA DeleteFileW MoveFileA"),
]

# What a dependency may reach, in the same form.
SUPPLY_CHAIN = [
    ("Process Execution", "T1059", "process_execution", "high", False, "Command CommandContext Run Start Output CombinedOutput StartProcess Exec Popen call check_output check_call execFile spawn fork"),
    ("Network Access", "T1071", "network_access", "high", False, "Get Post PostForm Do Head NewRequest Dial DialContext DialTLS ListenAndServe ListenAndServeTLS Fetch request urlopen urlretrieve"),
    ("File System Access", "T1005", "file_access", "medium", False, "Open Create OpenFile ReadFile WriteFile Remove RemoveAll Rename Mkdir MkdirAll Chmod Chown Symlink Link readFile writeFile readFileSync writeFileSync unlink unlinkSync"),
    ("Environment Access", "T1082", "environment_access", "low", False, "Getenv LookupEnv Setenv Unsetenv Environ getenv setenv putenv"),
    ("Code Evaluation", "T1059", "code_eval", "high", False, "eval Eval exec compile RunString Interpret"),
    ("Unsafe Memory", "T1055", "unsafe_memory", "medium", False, "Pointer NewPointer Offsetof Sizeof Slice SliceData StringData"),
]

CONFIDENCE = {"low": 1, "medium": 2, "high": 3}

# Default thresholds of the lint rules and of the quality gate (a greater value fails).
THRESHOLDS = {"cyclomatic": 25, "cognitive": 50, "lines": 200, "max_nesting": 5, "parameters": 7, "fan_in": 30, "fan_out": 15}
GATE = {"cyclomatic": 50, "cognitive": 80, "lines": 300}

# When a function shows a smell: name, severity, condition.
SMELLS = [
    ("god_function", "error", "cyclomatic > 30 AND lines > 200 AND fan_out > 20"),
    ("shotgun_surgery", "warning", "fan_in > 30"),
    ("long_params", "warning", "parameters > 5"),
    ("deep_nesting", "warning", "max_nesting > 4"),
]

# Names of test files, by language; `any` is for the others.
TEST_FILES = {
    "go": r"_test\.go$",
    "python": r"(^|/)test_[^/]*\.py$|_test\.py$|(^|/)tests/",
    "javascript": r"\.(test|spec)\.(js|ts|tsx|jsx)$|(^|/)__tests__/",
    "java": r"tests?\.java$|test\.kt$|(^|/)src/test/",
    "rust": r"(^|/)tests/",
    "ruby": r"_(spec|test)\.rb$",
    "any": r"test[^/]*$|_spec\.rb$|\.spec\.(js|ts|tsx|jsx)$|(^|/)(test|tests|__tests__)/",
}
TEST_ALIASES = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "kotlin": "java"}
